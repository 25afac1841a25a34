"""Citation markers inside answers, and addresses of cited evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = r"\[(E[0-9]+)\]"


def cited_ids(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)))


def insert_citations(answer: Column, evidence_ids: Column) -> Column:
    """Put all markers behind every sentence end, or behind the text when there is none."""
    markers = F.array_join(F.transform(evidence_ids, lambda item: F.concat(F.lit("["), item, F.lit("]"))), " ")
    end = r"([.!?])(?=\s|$)"
    return F.when(answer.rlike(end), F.regexp_replace(answer, F.lit(end), F.concat(F.lit("$1 "), markers))).otherwise(F.concat(answer, F.lit(" "), markers))


def page_url(alias: Column) -> Column:
    return F.concat(F.lit("/wiki/"), F.replace(F.url_encode(alias), F.lit("+"), F.lit("%20")))


def section_url(document_id: Column, ordinal: Column) -> Column:
    offset = F.floor(ordinal / 50) * 50
    return F.concat(
        F.lit("/documents/"), document_id.cast("string"), F.lit("/content?offset="), offset.cast("string"), F.lit("#section-"), ordinal.cast("string")
    )


def locator_text(locator: Column) -> Column:
    parts = F.concat_ws(
        " · ",
        F.concat(F.lit("page "), locator["page"].cast("string")),
        F.concat(F.lit("slide "), locator["slide"].cast("string")),
        F.when(locator["sheet"] != "", F.concat(F.lit("sheet "), locator["sheet"])),
        F.when(locator["range"] != "", F.concat(F.lit("range "), locator["range"])),
        F.when(locator["heading"] != "", F.concat(F.lit("heading "), locator["heading"])),
        F.when(locator["image"] != "", F.concat(F.lit("image "), locator["image"])),
        F.when(locator["part"] != "", locator["part"]),
    )
    return F.when(parts == "", locator["label"]).otherwise(parts)
