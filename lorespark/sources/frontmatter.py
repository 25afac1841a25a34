"""Pages and revisions as Markdown with a YAML header, and archives of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.text import sha256_hex, strip
from ..operators.filters import active
from ..operators.tree import breadcrumbs

VERSION_KEY = "archive_version"
HEADER = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"


def _scalar(value: Column) -> Column:
    """A string as a YAML scalar; JSON strings are valid YAML."""
    return F.when(value.isNotNull(), F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', ""))


def _block(name: str, lines: Column, empty: str) -> Column:
    return F.when(F.size(lines) == 0, F.lit(f"{name}: {empty}")).otherwise(F.concat(F.lit(f"{name}:\n"), F.array_join(lines, "\n")))


def _iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def markdown_document(fields: dict[str, Column], body: Column) -> Column:
    """Header lines in key order, then the body. A null line is left out."""
    lines = F.array_compact(F.array(*[fields[name] for name in sorted(fields)]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body)


def page_fields(parent_alias: Column | None = None) -> dict[str, Column]:
    properties = F.transform(F.map_entries("properties"), lambda item: F.concat(F.lit('  "'), item["key"], F.lit('": '), item["value"]))
    tags = F.transform("tags", lambda tag: F.concat(F.lit("  - "), _scalar(tag)))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return {
        VERSION_KEY: F.lit(f"{VERSION_KEY}: 1"),
        "title": line("title", _scalar(F.col("title"))),
        "alias": line("alias", _scalar(F.col("alias"))),
        "tags": _block("tags", tags, "[]"),
        "status": line("status", F.col("status")),
        "parent": line("parent", _scalar(parent_alias)) if parent_alias is not None else F.lit(None).cast("string"),
        "parent_id": line("parent_id", F.col("parent_id").cast("string")),
        "properties": _block("properties", properties, "{}"),
        "created_at": line("created_at", _iso(F.col("created_at"))),
    }


def export_pages(pages: DataFrame, with_parents: bool = True) -> DataFrame:
    """(id, path, content) of pages, live and deleted."""
    if with_parents:
        aliases = active(pages).select(F.col("id").alias("parent_id"), F.col("alias").alias("_parent_alias"))
        pages = pages.join(aliases, "parent_id", "left")
        fields = page_fields(F.col("_parent_alias"))
    else:
        fields = page_fields()
    fields["updated_at"] = F.concat(F.lit("updated_at: "), _iso(F.col("updated_at")))
    fields["deleted_at"] = F.concat(F.lit("deleted_at: "), _iso(F.col("deleted_at")))
    folder = F.when(F.col("deleted_at").isNull(), F.lit("pages/")).otherwise(F.lit("trash/"))
    path = F.concat(folder, F.col("id").cast("string"), F.lit("-"), F.coalesce("deleted_alias", "alias"), F.lit(".md"))
    return pages.select("id", path.alias("path"), markdown_document(fields, F.col("body")).alias("content"))


def export_revisions(revisions: DataFrame) -> DataFrame:
    fields = page_fields()
    fields["revision_id"] = F.concat(F.lit("revision_id: "), F.col("id").cast("string"))
    fields["source"] = F.concat(F.lit("source: "), F.col("source"))
    path = F.concat(F.lit("revisions/"), F.col("page_id").cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".md"))
    return revisions.select("id", path.alias("path"), markdown_document(fields, F.col("body")).alias("content"))


def manifest(*files: DataFrame) -> DataFrame:
    """(path, sha256, size) of exported files."""
    from functools import reduce

    rows = [frame.select("path", sha256_hex(F.col("content")).alias("sha256"), F.octet_length("content").cast("bigint").alias("size")) for frame in files]
    return reduce(DataFrame.unionByName, rows)


# Lines of a header: a key with or without a value, a list item, and an entry of a mapping.
KEY_LINE, ITEM_LINE, ENTRY_LINE = r"[A-Za-z_]\w*:(?: .*)?", r"  - .*", r'  (?:"(?:[^"\\]++|\\.)*+"|[\w.-]+): .*'


def _text_value(raw: Column) -> Column:
    """A scalar as text: a JSON string, a quoted or a plain one; null for anything else."""
    plain = strip(raw)
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), plain, F.lit("}")), "$.v")
    return (
        F.when(plain.rlike(r'^"(?:[^"\\]++|\\.)*+"$'), quoted)
        .when(plain.rlike("^'.*'$"), F.replace(F.substring(plain, F.lit(2), F.length(plain) - 2), F.lit("''"), F.lit("'")))
        .when(~plain.rlike(r"^[\[{>|&*!%@`]") & (plain != ""), plain)
    )


def _json_value(raw: Column) -> Column:
    """A scalar as JSON: numbers, truth values and null as they are, anything else as a string; null for lists and mappings."""
    plain = strip(raw)
    return F.when(plain.rlike(r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"), plain).otherwise(_scalar(_text_value(plain)))


def parse_header(header: Column) -> Column:
    """Fields of a header as the exporter writes it: one line for a key, indented lines for lists and mappings.

    Values are JSON; plain and single-quoted text is understood too. Nested values are refused.
    """
    return bind(F.regexp_replace(header, "\r", ""), _parsed)


def _parsed(text: Column) -> Column:
    lines = F.split(text, "\n")
    present = lambda name: text.rlike(f"(?m)^{name}:")
    raw = lambda name: F.regexp_extract(text, f"(?m)^{name}: *(.*)$", 1)
    block = lambda name: F.filter(F.split(F.regexp_extract(text, f"(?m)^{name}: *\\n((?:  .*(?:\\n|\\z))+)", 1), "\n"), lambda line: line != "")
    value = lambda name: F.when(present(name) & (raw(name) != "null"), _text_value(raw(name)))

    tag_lines, entry_lines = block("tags"), block("properties")
    inline_tags = F.from_json(raw("tags"), "array<string>")
    tags = F.when(~present("tags"), F.array().cast("array<string>")).when(raw("tags") == "", F.transform(tag_lines, lambda line: _text_value(F.regexp_replace(line, "^  - ", "")))).otherwise(inline_tags)
    tags_ok = tags.isNotNull() & ~F.exists(tags, lambda tag: tag.isNull()) & (F.forall(tag_lines, lambda line: line.rlike(f"^{ITEM_LINE}$")))
    entry = r'^  ("(?:[^"\\]++|\\.)*+"|[\w.-]+): (.*)$'
    entries = F.transform(entry_lines, lambda line: F.struct(_text_value(F.regexp_extract(line, entry, 1)).alias("key"), _json_value(F.regexp_extract(line, entry, 2)).alias("value")))
    entries_ok = (~present("properties") | raw("properties").isin("", "{}")) & F.forall(entry_lines, lambda line: line.rlike(entry)) & ~F.exists(entries, lambda item: item["value"].isNull())
    status = F.coalesce(value("status"), F.lit("published"))
    error = (
        F.when(text.isNull(), "Markdown import requires YAML front matter")
        .when(~F.get(lines, F.lit(0)).rlike(f"^{KEY_LINE}$"), "front matter must be a mapping")
        .when(F.exists(lines, lambda line: ~line.rlike(f"^(?:{KEY_LINE}|{ITEM_LINE}|{ENTRY_LINE})$")), "YAML front matter is invalid")
        .when(present(VERSION_KEY) & (strip(raw(VERSION_KEY)) != "1"), "only front matter version 1 is supported")
        .when(present("title") & raw("title").rlike(r"^[\[{]"), "YAML front matter is invalid")
        .when(F.coalesce(strip(value("title")), F.lit("")) == "", "title must be a non-empty string")
        .when(~tags_ok, "tags must be a string array")
        .when(~status.isin("draft", "published", "archived"), "status must be draft, published, or archived")
        .when(~entries_ok, "properties must be scalars")
    )
    fields = {
        "title": value("title"), "alias": F.when(value("alias") != "", value("alias")), "tags": tags, "status": status,
        "parent": F.when(value("parent") != "", value("parent")), "properties": F.map_from_entries(entries),
    }
    return F.struct(*[F.when(error.isNull(), column).alias(name) for name, column in fields.items()], error.alias("error"))


def import_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Inputs for `create_pages` from Markdown files (no, content): parents by alias, else root."""
    # A file is made and opened once, its header taken out once: a generator keeps later steps from copying the expression.
    def opened(content: Column) -> Column:
        def split(matched: Column) -> Column:
            header = F.when(matched != "", F.regexp_extract(matched, HEADER, 1))
            return F.struct(parse_header(header).alias("_parsed"), F.substring(content, F.length(matched) + 1, F.length(content)).alias("body"))

        return bind(F.regexp_extract(content, HEADER, 0), split)

    parsed = files.select("no", F.inline(F.array(bind(F.col("content"), opened))))
    parents = active(pages).select(F.col("alias").alias("parent"), F.col("id").alias("parent_id"))
    shaped = parsed.select("no", "_parsed.*", "body")
    return shaped.join(parents, "parent", "left").drop("parent")


def capture_article(markdown: DataFrame, assets: DataFrame) -> DataFrame:
    """Captured articles (web_capture_id, content) with local resource paths in place of stored ones.

    The assets of a page are limited at capture, so they fit one array.
    """
    stored = F.concat(F.lit("/web-assets/"), F.col("blob_sha256"), F.lit("/"), F.replace(F.url_encode("filename"), F.lit("+"), F.lit("%20")))
    local = F.concat(F.lit("resources/"), F.substring("blob_sha256", 1, 12), F.lit("-"), F.col("filename"))
    pairs = assets.select("web_capture_id", F.struct(stored.alias("stored"), local.alias("local")).alias("pair")).distinct()
    listed = pairs.groupBy("web_capture_id").agg(F.array_sort(F.collect_list("pair")).alias("_pairs"))
    joined = markdown.join(listed, "web_capture_id", "left")
    rewritten = F.aggregate("_pairs", F.col("content"), lambda text, pair: F.replace(text, pair["stored"], pair["local"]))
    return joined.withColumn("content", F.coalesce(rewritten, F.col("content"))).drop("_pairs")


__all__ = ["export_pages", "export_revisions", "import_pages", "manifest", "breadcrumbs"]
