"""Cutting texts: plain-text parts, Markdown sections, long sections, overlapping chunks.

All cuts are folds over one text, expressed with higher-order functions, so the
text never leaves the JVM and no row depends on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.text import sha256_hex, strip
from .filters import json_text

# Sizes in characters.
PART_CHARS = 20_000
PART_MIN_CHARS = 10_000
SECTION_CHARS = 50_000
PREFERRED_CUT = 0.6

LOCATOR_FIELDS = {
    "label": "string", "page": "int", "slide": "int", "sheet": "string",
    "range": "string", "heading": "string", "image": "string", "part": "string",
}


def locator(**fields: Column) -> Column:
    return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in LOCATOR_FIELDS.items()])


def last_blank_line(window: Column) -> Column:
    """Zero-based position of the last blank line in a text, or -1."""
    return bind(F.instr(F.reverse(window), "\n\n"), lambda found: F.when(found > 0, F.length(window) - found - 1).otherwise(F.lit(-1)))


def cut(text: Column, size: int, earliest: int, overlap: int) -> Column:
    """Array of consecutive pieces of at most `size` characters.

    A piece ends at the last blank line of its window when that lies beyond
    `earliest`; the next piece starts `overlap` characters before the end, but
    always moves on.
    """
    return bind(text, lambda source: _cut(source, size, earliest, overlap))


def _cut(text: Column, size: int, earliest: int, overlap: int) -> Column:
    advance = max(1, earliest + 1 - overlap)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(text) / advance).cast("int") + 1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"), (F.length(text) == 0).alias("done"))

    def step(state: Column, _: Column) -> Column:
        whole = state["at"] + size >= F.length(text)

        def take(window: Column) -> Column:
            boundary = last_blank_line(window)
            length = F.when(whole, F.length(text) - state["at"]).otherwise(bind(boundary, lambda at: F.when(at > earliest, at).otherwise(F.lit(size))))
            return bind(
                length,
                lambda taken: F.struct(
                    F.greatest(state["at"] + 1, state["at"] + taken - overlap).alias("at"),
                    F.array_append(state["pieces"], F.substring(window, F.lit(1), taken)).alias("pieces"),
                    whole.alias("done"),
                ),
            )

        return F.when(state["done"], state).otherwise(bind(F.substring(text, state["at"] + 1, F.lit(size + 2)), take))

    cut_everywhere = F.aggregate(steps, start, step)["pieces"]
    return F.when(F.length(text) > size, cut_everywhere).otherwise(F.filter(F.array(text), lambda piece: piece != ""))


def chunk_text(text: Column, size: int = 1600, overlap: int = 200) -> Column:
    """Distinct, trimmed, non-empty chunks in order."""
    pieces = F.transform(cut(text, size, int(size * PREFERRED_CUT), overlap), strip)
    return F.array_distinct(F.filter(pieces, lambda piece: piece != ""))


def page_chunk_source(title: Column, alias: Column, tags: Column, properties: Column, body: Column) -> Column:
    pairs = F.transform(F.map_entries(properties), lambda item: F.concat(item["key"], F.lit(": "), json_text(item["value"])))
    lines = F.filter(F.array(title, alias, F.array_join(tags, " "), F.array_join(pairs, "\n")), lambda line: line != "")
    source = strip(F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), body))
    return F.coalesce(F.nullif(source, F.lit("")), title)


def page_chunks(pages: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """(page_id, ordinal, content, content_hash)."""
    source = page_chunk_source(*[F.col(name) for name in ("title", "alias", "tags", "properties", "body")])
    chunks = pages.select(F.col("id").alias("page_id"), F.posexplode(chunk_text(source, size, overlap)).alias("ordinal", "content"))
    return chunks.withColumn("content_hash", sha256_hex(F.col("content")))


def section_chunks(sections: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """(section_id, ordinal, content, content_hash); the header names file, format, kind and place."""
    header = F.filter(
        F.array(F.col("filename"), F.upper("format"), F.col("kind"), F.col("locator.label"), F.when(F.col("hidden"), F.lit("hidden"))),
        lambda line: F.coalesce(line, F.lit("")) != "",
    )
    source = strip(F.concat(F.array_join(header, "\n"), F.lit("\n\n"), F.col("text")))
    chunks = sections.select("section_id", F.posexplode(chunk_text(source, size, overlap)).alias("ordinal", "content"))
    return chunks.withColumn("content_hash", sha256_hex(F.col("content")))


def page_content_hash() -> Column:
    """Hash of everything that a page's chunks are made of."""
    return sha256_hex(F.to_json(F.struct("title", "alias", "body", "tags", "properties")))


def stale_pages(pages: DataFrame, index_state: DataFrame) -> DataFrame:
    """Pages whose indexed hash is missing or differs."""
    hashed = pages.withColumn("content_hash", page_content_hash())
    state = index_state.select(F.col("page_id").alias("id"), "content_hash")
    return hashed.join(state, ["id", "content_hash"], "left_anti")


def document_hashes(versions: DataFrame, sections: DataFrame) -> DataFrame:
    """(document_id, version_id, content_hash): hash of everything that a version's section chunks are made of.

    Sections are hashed one by one, so only digests of a version come together.
    """
    one = sections.select("version_id", "ordinal", sha256_hex(F.to_json(F.struct("section_id", "kind", "locator", "text", "hidden"))).alias("digest"))
    listed = one.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "digest"))).alias("parts"))
    joined = versions.select(F.col("id").alias("version_id"), "document_id", "sha256").join(listed, "version_id", "left")
    parts = F.coalesce(F.array_join(F.transform("parts", lambda part: part["digest"]), ","), F.lit(""))
    return joined.select("document_id", "version_id", sha256_hex(F.concat_ws("|", F.col("version_id").cast("string"), "sha256", parts)).alias("content_hash"))


def stale_documents(hashes: DataFrame, index_state: DataFrame) -> DataFrame:
    """Documents whose indexed hash is missing or differs."""
    return hashes.join(index_state.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")


def vanished(index_rows: DataFrame, key: str, entities: DataFrame) -> DataFrame:
    """Index rows whose entity is not there any more (`entities` has the same key): to be taken out of the index."""
    return index_rows.join(entities.select(key), key, "left_anti")


def plain_parts(text: Column) -> Column:
    """Sections of a plain text: array of (kind, title, locator, text, hidden, needs_ocr)."""
    clean = strip(F.regexp_replace(text, r"\r\n?", "\n"))
    pieces = cut(clean, PART_CHARS, PART_MIN_CHARS, 0)
    return F.transform(
        pieces,
        lambda piece, position: section(
            "text", F.lit(None), locator(label=F.concat(F.lit("Part "), (position + 1).cast("string")), part=F.concat(F.lit("part "), (position + 1).cast("string"))), piece
        ),
    )


def section(kind: str | Column, title: Column, where: Column, text: Column, hidden: Column | None = None, needs_ocr: Column | None = None) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        title.cast("string").alias("title"),
        where.alias("locator"),
        strip(text).alias("text"),
        (F.lit(False) if hidden is None else hidden).alias("hidden"),
        (F.lit(False) if needs_ocr is None else needs_ocr).alias("needs_ocr"),
    )


HEADING = r"(?m)^#{1,6}\s+(.+)$"


def markdown_sections(text: Column) -> Column:
    """Sections of a Markdown text, one per heading; without headings, plain parts."""

    def split(source: Column) -> Column:
        headings = F.transform(F.regexp_extract_all(source, F.lit(HEADING), F.lit(1)), strip)
        return F.when(source.rlike(HEADING), bind(F.split(source, HEADING, -1), lambda bodies: headed(headings, bodies))).otherwise(plain_parts(source))

    def headed(headings: Column, bodies: Column) -> Column:
        preamble = section("text", F.lit(None), locator(label=F.lit("Preamble")), F.element_at(bodies, 1))
        sections = F.zip_with(
            headings,
            F.slice(bodies, F.lit(2), F.size(bodies) - 1),
            lambda heading, body: section("heading", heading, locator(label=F.concat(F.lit("Heading: "), heading), heading=heading), F.coalesce(body, F.lit(""))),
        )
        return F.concat(F.filter(F.array(preamble), lambda item: F.element_at(bodies, 1) != ""), sections)

    return bind(text, split)


def markdown_first_heading(text: Column) -> Column:
    heading = strip(F.regexp_extract(text, HEADING, 1))
    return F.when(heading != "", heading)


def finish_sections(sections: Column) -> Column:
    """Drop empty sections and split long ones into numbered parts."""
    usable = F.filter(sections, lambda item: (item["text"] != "") | item["needs_ocr"])

    def split_long(item: Column) -> Column:
        count = F.ceil(F.length(item["text"]) / SECTION_CHARS).cast("int")
        parts = F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda part: F.struct(
                item["kind"].alias("kind"),
                item["title"].alias("title"),
                item["locator"].withField("label", F.concat(item["locator"]["label"], F.lit(" (part "), part.cast("string"), F.lit(")"))).alias("locator"),
                F.substring(item["text"], (part - 1) * SECTION_CHARS + 1, F.lit(SECTION_CHARS)).alias("text"),
                item["hidden"].alias("hidden"),
                item["needs_ocr"].alias("needs_ocr"),
            ),
        )
        return F.when(count > 1, parts).otherwise(F.array(item))

    return F.flatten(F.transform(usable, split_long))


def extraction_warnings(sections: Column, needs_ocr: Column) -> Column:
    return F.when((F.size(sections) == 0) & ~needs_ocr, F.array(F.lit("no extractable text was found"))).otherwise(F.array().cast("array<string>"))


def explode_sections(documents: DataFrame, sections: Column, keep: list[str]) -> DataFrame:
    """One row per section with its zero-based ordinal."""
    return documents.select(*keep, F.posexplode(sections).alias("ordinal", "section")).select(*keep, "ordinal", "section.*")
