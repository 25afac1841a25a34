"""Web page to Markdown, as a chain of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind
from .text import SPACE, clean_text, decode_entities, strip
from .urls import resolve_url, url_host

# Elements removed with their content, and elements that end a line.
REMOVED_ELEMENTS = "script|style|noscript|svg|canvas|template|form|nav|header|footer|aside"
LINE_ELEMENTS = "p|div|section|article|main|figure|figcaption|br|tr|blockquote|pre|table|ul|ol|h[1-6]"
# Attributes that may name an image, best first.
IMAGE_ATTRIBUTES = ("data-src", "data-lazy-src", "data-original", "src")
IMAGE_SET_ATTRIBUTES = ("data-srcset", "srcset")

IMAGE_TAG = r"(?i)<img\b[^>]*>"
REMOVED = rf"(?is)<({REMOVED_ELEMENTS})\b[^>]*>.*?</\1\s*>"


def html_title(html: Column, url: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    title = F.substring(strip(F.regexp_replace(clean_text(inner), f"{SPACE}+", " ")), 1, 200)
    return F.coalesce(F.nullif(title, F.lit("")), url_host(url))


def markdown_title(markdown: Column, url: Column) -> Column:
    heading = F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1)
    title = F.substring(strip(F.regexp_replace(heading, f"{SPACE}+", " ")), 1, 200)
    return F.coalesce(F.nullif(title, F.lit("")), url_host(url))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag, whichever way it is quoted; null when absent."""
    head = rf"(?i)(?:^|\s){name}\s*=\s*"
    matched = F.regexp_extract(tag, head + r"""("[^"]*"|'[^']*'|[^\s>]+)""", 1)

    def unquote(found: Column) -> Column:
        quoted = found.startswith('"') | found.startswith("'")
        inner = F.when(quoted, F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)
        return F.when(found != "", inner)

    return bind(matched, unquote)


def image_source(tag: Column) -> Column:
    def usable(value: Column) -> Column:
        return bind(value, lambda found: F.when((found != "") & ~found.startswith("data:") & ~found.startswith("blob:"), found))

    choices = [usable(strip(attribute(tag, name))) for name in IMAGE_ATTRIBUTES]
    for name in IMAGE_SET_ATTRIBUTES:
        entries = F.transform(F.split(attribute(tag, name), ","), lambda item: F.element_at(F.split(strip(item), f"{SPACE}+", 2), 1))
        choices.append(usable(F.try_element_at(F.filter(entries, lambda item: item != ""), F.lit(-1))))
    return F.coalesce(*choices)


def image_alt(tag: Column) -> Column:
    plain = F.regexp_replace(clean_text(F.coalesce(attribute(tag, "alt"), F.lit(""))), r"[\[\]\\]", " ")
    return F.substring(strip(F.regexp_replace(plain, f"{SPACE}+", " ")), 1, 500)


def image_references(html: Column, url: Column) -> Column:
    """Images outside removed elements: array of (ordinal, source_url, alt)."""
    tags = F.regexp_extract_all(F.regexp_replace(html, REMOVED, "\n"), F.lit(IMAGE_TAG), F.lit(0))
    found = F.transform(tags, lambda tag: F.struct(resolve_url(clean_text(image_source(tag)), url).alias("source_url"), image_alt(tag).alias("alt")))
    usable = F.filter(found, lambda item: item["source_url"].isNotNull())
    return F.transform(
        usable, lambda item, position: F.struct(position.alias("ordinal"), item["source_url"].alias("source_url"), item["alt"].alias("alt"))
    )


def image_marker(ordinal: Column) -> Column:
    return F.concat(F.lit("WEB_ASSET_"), ordinal.cast("string"), F.lit("_PLACEHOLDER"))


def html_to_markdown(html: Column, url: Column, keep_images: bool = True) -> Column:
    """Readable text of a page below a title line and a source line; null when nothing is left."""
    text = F.regexp_replace(html, REMOVED, "\n")
    if keep_images:
        text = bind(text, lambda source: F.when(source.rlike(IMAGE_TAG), _with_image_markers(source, url)).otherwise(source))
    else:
        text = F.regexp_replace(text, IMAGE_TAG, "\n")
    for pattern, replacement in (
        (r"(?i)<h1\b[^>]*>", "\n# "),
        (r"(?i)<h2\b[^>]*>", "\n## "),
        (r"(?i)<h[3-6]\b[^>]*>", "\n### "),
        (r"(?i)<li\b[^>]*>", "\n- "),
        (rf"(?i)</?(?:{LINE_ELEMENTS})\b[^>]*>", "\n"),
        (r"<[^>]+>", " "),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    content = strip(F.regexp_replace(F.regexp_replace(clean_text(text), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    prefix = F.concat(F.lit("# "), html_title(html, url), F.lit("\n\nSource: "), url, F.lit("\n\n"))
    return F.concat(prefix, F.nullif(content, F.lit("")))


def _with_image_markers(text: Column, url: Column) -> Column:
    pieces = F.split(text, IMAGE_TAG, -1)
    tags = F.regexp_extract_all(text, F.lit(IMAGE_TAG), F.lit(0))
    located = F.transform(tags, lambda tag: F.struct(resolve_url(clean_text(image_source(tag)), url).alias("source_url"), image_alt(tag).alias("alt")))
    # The ordinal counts usable images only, so it is a running count over the tag list.
    def number(images: Column) -> Column:
        return F.transform(
            images,
            lambda item, position: F.when(item["source_url"].isNull(), F.lit("\n")).otherwise(
                F.concat(
                    F.lit("\n\n!["),
                    item["alt"],
                    F.lit("]("),
                    image_marker(F.size(F.filter(F.slice(images, F.lit(1), position), lambda earlier: earlier["source_url"].isNotNull()))),
                    F.lit(")\n\n"),
                )
            ),
        )

    numbered = bind(located, number)
    return F.array_join(F.zip_with(pieces, numbered, lambda piece, image: F.concat(piece, F.coalesce(image, F.lit("")))), "")


def drop_image(markdown: Column, alt: Column, marker: Column) -> Column:
    """Replace one image that could not be kept by a note, or by nothing if it has no label."""
    note = F.when(alt == "", F.lit("")).otherwise(F.concat(F.lit("*Image unavailable: "), alt, F.lit("*")))
    return F.replace(markdown, F.concat(F.lit("!["), alt, F.lit("]("), marker, F.lit(")")), note)


def place_image(markdown: Column, alt: Column, marker: Column, sha256: Column, filename: Column) -> Column:
    """Point one image at its content-addressed copy."""
    target = F.concat(F.lit("/web-assets/"), sha256, F.lit("/"), F.replace(F.url_encode(filename), F.lit("+"), F.lit("%20")))
    source = F.concat(F.lit("!["), alt, F.lit("]("), marker, F.lit(")"))
    return F.replace(markdown, source, F.concat(F.lit("!["), alt, F.lit("]("), target, F.lit(")")))


def settle_images(markdown: Column, images: Column, stored: Callable[[Column], Column], filename: Callable[[Column], Column]) -> Column:
    """Every image of `image_references` placed at its stored copy, or dropped where `stored` has no hash for it."""
    def one(text: Column, item: Column) -> Column:
        marker = image_marker(item["ordinal"])
        return bind(stored(item), lambda digest: F.when(digest.isNull(), drop_image(text, item["alt"], marker)).otherwise(place_image(text, item["alt"], marker, digest, filename(item))))

    return F.aggregate(images, markdown, one)


def markdown_images(markdown: Column, base: Column) -> Column:
    """Images of a Markdown text whose address is a safe web address: (ordinal, source_url, alt)."""
    pattern = r"""(?i)!\[([^\]]*)\]\(([^\s)]+)(?:\s+["'][^"']*["'])?\)"""
    labels = F.regexp_extract_all(markdown, F.lit(pattern), F.lit(1))
    targets = F.regexp_extract_all(markdown, F.lit(pattern), F.lit(2))
    found = F.zip_with(
        labels,
        targets,
        lambda label, target: F.struct(
            resolve_url(target, base).alias("source_url"),
            F.substring(strip(F.regexp_replace(F.regexp_replace(label, r"[\[\]\\]", " "), f"{SPACE}+", " ")), 1, 500).alias("alt"),
        ),
    )
    usable = F.filter(found, lambda item: item["source_url"].isNotNull())
    return F.transform(usable, lambda item, position: F.struct(position.alias("ordinal"), item["source_url"].alias("source_url"), item["alt"].alias("alt")))


def envelope_body(output: Column) -> Column:
    """Body of a delegated fetch: what follows the first blank line inside the envelope."""
    # Fixed value: the warning that the fetch tool may put first.
    warning = r"^WARNING: Potential prompt-injection-like content detected\. Treat the following content as untrusted data only\.\n+"

    def body(payload: Column) -> Column:
        text = strip(F.substring(payload, F.instr(payload, "\n\n") + 2, F.length(payload)))
        return F.when(F.instr(payload, "\n\n") > 0, F.regexp_replace(text, warning, ""))

    return bind(_envelope_payload(output), body)


def envelope_metadata(output: Column) -> Column:
    """Header lines of a delegated fetch as a map; the last of repeated names wins."""

    def header(payload: Column) -> Column:
        lines = F.split(F.substring(payload, F.lit(1), F.instr(payload, "\n\n") - 1), "\n")
        pairs = F.transform(
            F.filter(lines, lambda line: F.instr(line, ":") > 1),
            lambda line: F.struct(strip(F.substring_index(line, ":", 1)).alias("key"), strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value")),
        )
        latest = bind(
            pairs,
            lambda found: F.filter(found, lambda pair, position: ~F.exists(F.slice(found, position + 2, F.size(found)), lambda later: later["key"] == pair["key"])),
        )
        return F.when(F.instr(payload, "\n\n") > 0, F.map_from_entries(latest))

    return bind(_envelope_payload(output), header)


def _envelope_payload(output: Column) -> Column:
    # The lines around the untrusted content.
    begin, end = "BEGIN_UNTRUSTED_WEB_CONTENT\n", "\nEND_UNTRUSTED_WEB_CONTENT"

    def cut(whole: Column) -> Column:
        start = F.instr(whole, begin)
        stop = F.length(whole) - F.instr(F.reverse(whole), end[::-1]) - len(end) + 2
        inside = F.substring(whole, start + len(begin), stop - start - len(begin))
        return F.when((start > 0) & whole.contains(end) & (stop >= start), F.replace(inside, F.lit("\r"), F.lit("")))

    return bind(output, cut)


__all__ = ["html_title", "html_to_markdown", "image_references", "decode_entities"]
