"""Text normalisation as built-in column expressions.

`fold` reproduces the folding of the full-text tokenizer (lower case, Latin
letters without diacritics); `slugify` uses the wider compatibility folding.
Both lookup strings are computed from the Unicode database, so that a single
`translate` does the whole fold inside the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind
from ..model import ALIAS_PATTERN, MAX_ALIAS_CHARS, MAX_TAG_CHARS, MAX_TAGS, RequestError

# Combining marks that the tokenizer drops inside a word.
DROPPED_MARKS = (
    "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b"
    "\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
)
# Letters that keep their marks although their base is Latin.
UNFOLDED_LETTERS = "ǡ"
TOKEN_BREAK = r"[^\p{L}\p{N}\p{Co}]+"
# The white space that trimming removes and that patterns accept.
WHITESPACE = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


@lru_cache(maxsize=None)
def _latin_fold() -> dict[str, str]:
    table = {}
    for point in range(0xC0, 0x2C00):
        letter = chr(point)
        if letter != letter.lower() or letter in UNFOLDED_LETTERS:
            continue
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and "a" <= parts[0] <= "z" and all(unicodedata.combining(mark) for mark in parts[1:]):
            table[letter] = parts[0]
    return table


@lru_cache(maxsize=None)
def _slug_fold() -> dict[str, str]:
    """Code points below U+FFFF whose NFKD form, without marks, is one ASCII character."""
    table = {}
    for point in list(range(0xA0, 0x3400)) + list(range(0xF900, 0xFFF0)):
        letter = chr(point)
        plain = "".join(part for part in unicodedata.normalize("NFKD", letter) if not 0x300 <= ord(part) <= 0x36F).lower()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            table[letter] = plain
    return table


@lru_cache(maxsize=None)
def _slug_expansions() -> tuple[tuple[str, str], ...]:
    """Latin ligatures and digraphs whose NFKD form is several ASCII letters."""
    pairs = []
    for point in list(range(0x132, 0x1F4)) + list(range(0xFB00, 0xFB07)):
        plain = "".join(part for part in unicodedata.normalize("NFKD", chr(point)) if not 0x300 <= ord(part) <= 0x36F).lower()
        if len(plain) > 1 and plain.isascii() and plain.isalnum():
            pairs.append((chr(point), plain))
    return tuple(pairs)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(text, F.lit(WHITESPACE))


def fold(text: Column) -> Column:
    table = _latin_fold()
    return F.translate(F.lower(text), "".join(table) + DROPPED_MARKS, "".join(table.values()))


def fold_string(text: str) -> str:
    table = {ord(key): value for key, value in _latin_fold().items()}
    table.update({ord(mark): None for mark in DROPPED_MARKS})
    return text.lower().translate(table)


def tokens(text: Column) -> Column:
    """Search tokens of a text, in order."""
    return F.array_remove(F.split(fold(text), TOKEN_BREAK), "")


def spaced_tokens(text: Column) -> Column:
    """The same tokens as one string with blanks between them: what leaves the JVM cheaply."""
    return F.array_join(tokens(text), " ")


def tokens_of_string(text: str) -> list[str]:
    kept = (letter if unicodedata.category(letter)[0] in "LN" or unicodedata.category(letter) == "Co" else " " for letter in fold_string(text))
    return "".join(kept).split()


def keyword_fold(text: Column) -> Column:
    """Compatibility folding used by slugs and by the keywords of a question."""
    table = _slug_fold()
    marks = "".join(chr(point) for point in range(0x300, 0x370))
    ligatures = "".join(letter for letter, _ in _slug_expansions())

    def spell_out(folded: Column) -> Column:
        expanded = folded
        for letter, plain in _slug_expansions():
            expanded = F.replace(expanded, F.lit(letter), F.lit(plain))
        return F.when(folded.rlike(f"[{ligatures}]"), expanded).otherwise(folded)

    return bind(F.translate(F.lower(text), "".join(table) + marks, "".join(table.values())), spell_out)


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(keyword_fold(text), "[^a-z0-9]+", "-")
    slug = F.rtrim(F.substring(F.trim(dashed, F.lit("-")), 1, 180), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.when(text.isNotNull(), F.lit("page")))


def normalize_alias(alias: Column) -> Column:
    return F.lower(strip(alias))


def is_valid_alias(alias: Column) -> Column:
    return is_alias_form(alias) & (F.length(alias) <= MAX_ALIAS_CHARS)


def is_alias_form(alias: Column) -> Column:
    """ALIAS_PATTERN in two flat patterns: its own repetition would run out of stack on a long text."""
    return alias.rlike("^[a-z0-9-]+$") & ~alias.rlike("^-|--|-$")


def check_alias(value: str) -> str:
    import re

    alias = value.strip().lower()
    if not re.match(ALIAS_PATTERN.rstrip("$") + r"\Z", alias) or len(alias) > MAX_ALIAS_CHARS:
        raise RequestError("invalid_alias", "alias must contain lowercase ASCII letters, numbers, and single hyphens")
    return alias


def normalize_tags(tags: Column) -> Column:
    """Trimmed, lower-case, distinct, non-empty, ascending."""
    cleaned = F.transform(tags, lambda tag: F.lower(strip(tag)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda tag: tag != "")))


def tags_error(tags: Column) -> Column:
    """Reason why a normalised tag list is refused, or null."""
    return F.when(F.size(tags) > MAX_TAGS, F.lit(f"a page may have at most {MAX_TAGS} tags")).when(
        F.exists(tags, lambda tag: F.length(tag) > MAX_TAG_CHARS), F.lit(f"tags may not exceed {MAX_TAG_CHARS} characters")
    )


def check_tags(values: list[str]) -> list[str]:
    tags = sorted({tag.strip().lower() for tag in values} - {""})
    if len(tags) > MAX_TAGS or any(len(tag) > MAX_TAG_CHARS for tag in tags):
        raise RequestError("invalid_tags", f"at most {MAX_TAGS} tags of at most {MAX_TAG_CHARS} characters")
    return tags


def tag_kind(tag: Column) -> Column:
    """Kind of a tag that was never defined, from its prefix."""
    prefix = F.regexp_extract(tag, "^(entity|source|type|topic):", 1)
    return F.when(prefix == "", F.lit("custom")).otherwise(prefix)


def excerpt(body: Column, limit: int = 180) -> Column:
    """Plain one-line preview of a Markdown body."""
    labels = F.regexp_replace(body, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2")
    links = F.regexp_replace(labels, r"\[\[([^\]|]+)\]\]", "$1")
    plain = strip(F.regexp_replace(F.regexp_replace(links, r"[`*_>#-]", " "), f"{SPACE}+", " "))
    return bind(plain, lambda line: F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("…"))).otherwise(line))


def wiki_links(body: Column) -> Column:
    """Valid aliases linked from a body, distinct, in order of first appearance."""
    targets = F.regexp_extract_all(body, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(targets, normalize_alias), is_alias_form))


def decode_entities(text: Column) -> Column:
    """HTML character references to text in one pass; unknown names become a blank.

    Fixed values: the six names that are known.
    """
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
    pattern = "(?i)&(#x?[0-9a-f]+|[a-z]+);"

    def character(entity: Column) -> Column:
        name = F.lower(entity)
        digits = F.when(name.startswith("#x"), F.substring(name, 3, 32)).otherwise(F.substring(name, 2, 32))
        base = F.when(name.startswith("#x"), F.lit(16)).otherwise(F.lit(10))
        point = F.when(
            (F.length(F.ltrim(digits, F.lit("0"))) <= 8) & ((base == 16) | digits.rlike("^[0-9]+$")),
            F.when(base == 16, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint"),
        )
        numeric = bind(
            point,
            lambda code: F.when(code.between(0xD800, 0xDFFF), F.lit("\ufffd")).when(
                (code > 0) & (code <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
            ),
        )
        known = F.lit(None).cast("string")
        for key, value in names.items():
            known = F.when(name == key, F.lit(value)).otherwise(known)
        return F.coalesce(F.when(name.startswith("#"), numeric).otherwise(known), F.lit(" "))

    def replace_all(source: Column) -> Column:
        pieces = F.split(source, pattern, -1)
        entities = F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), character)
        joined = F.array_join(F.zip_with(pieces, entities, lambda piece, entity: F.concat(piece, F.coalesce(entity, F.lit("")))), "")
        return F.when(source.contains("&"), joined).otherwise(source)

    return bind(text, replace_all)


def clean_text(text: Column) -> Column:
    decoded = F.replace(decode_entities(text), F.lit("\r"), F.lit(""))
    return F.regexp_replace(decoded, r"[\t ]+", " ")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def byte_size_label(size: Column) -> Column:
    kib, mib = F.lit(1024), F.lit(1024 * 1024)
    return (
        F.when(size < kib, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mib, F.concat(F.format_string("%.1f", size / kib), F.lit(" KiB")))
        .otherwise(F.concat(F.format_string("%.1f", size / mib), F.lit(" MiB")))
    )
