"""Page and section predicates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import check_tags, normalize_alias
from ..model import MAX_PROPERTIES, MAX_PROPERTY_CHARS, PAGE_STATUSES, PROPERTY_KEY_PATTERN, RequestError, SectionFilters
from .scale import latest_per


def active(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("deleted_at").isNull())


def deleted(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("deleted_at").isNotNull())


def with_status(pages: DataFrame, status: str, column: str = "status") -> DataFrame:
    if status == "all":
        return pages
    if status not in PAGE_STATUSES:
        raise RequestError("invalid_status", "status must be draft, published, archived, or all")
    return pages.filter(F.col(column) == status)


def with_all_tags(pages: DataFrame, tags: list[str]) -> DataFrame:
    """Pages that carry every tag; a predicate on the tag array, so nothing is shuffled."""
    for tag in check_tags(tags):
        pages = pages.filter(F.array_contains("tags", tag))
    return pages


def with_all_tags_by_edges(pages: DataFrame, page_tags: DataFrame, tags: list[str]) -> DataFrame:
    """The same over a separate (page_id, tag) table: one semi join, whatever the number of tags."""
    wanted = check_tags(tags)
    if not wanted:
        return pages
    matching = page_tags.filter(F.col("tag").isin(wanted)).groupBy("page_id").agg(F.count_distinct("tag").alias("found")).filter(F.col("found") == len(wanted))
    return pages.join(matching, pages["id"] == matching["page_id"], "left_semi")


def json_scalar(value) -> str:
    """JSON text of a property value; typed equality compares this text."""
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise RequestError("invalid_properties", "property values must be scalars")
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise RequestError("invalid_properties", "property values must be finite")
        if value == int(value):
            value = int(value)
    return json.dumps(value, ensure_ascii=False)


def check_properties(values: dict) -> dict[str, str]:
    """Normalised keys in order, with JSON text values."""
    import re

    result: dict[str, str] = {}
    for raw, value in values.items():
        key = raw.strip().lower()
        if not re.fullmatch(PROPERTY_KEY_PATTERN[1:-1], key) or key in result:
            raise RequestError("invalid_properties", f"property key '{raw}' is invalid or repeated")
        if isinstance(value, str) and len(value) > MAX_PROPERTY_CHARS:
            raise RequestError("invalid_properties", f"property '{key}' is too long")
        result[key] = json_scalar(value)
    if len(result) > MAX_PROPERTIES:
        raise RequestError("invalid_properties", f"a page may have at most {MAX_PROPERTIES} properties")
    return dict(sorted(result.items()))


def normalize_properties(properties: Column) -> Column:
    """Map with normalised keys, ordered by key."""
    entries = F.transform(F.map_entries(properties), lambda item: F.struct(F.lower(F.trim(item["key"])).alias("key"), item["value"].alias("value")))
    return F.map_from_entries(F.array_sort(entries))


def properties_error(properties: Column) -> Column:
    """Reason why a property map is refused, or null."""
    keys = F.transform(F.map_keys(properties), lambda key: F.lower(F.trim(key)))
    return (
        F.when(F.exists(keys, lambda key: ~key.rlike(PROPERTY_KEY_PATTERN)), F.lit("property key is invalid"))
        .when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("duplicate property key"))
        .when(F.exists(F.map_values(properties), lambda value: value.startswith('"') & (F.length(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")) > MAX_PROPERTY_CHARS)), F.lit("property is too long"))
        .when(F.size(keys) > MAX_PROPERTIES, F.lit("too many properties"))
    )


def with_properties(pages: DataFrame, properties: dict) -> DataFrame:
    for key, value in check_properties(properties).items():
        pages = pages.filter(F.try_element_at("properties", F.lit(key)) == value)
    return pages


def with_properties_by_rows(pages: DataFrame, page_properties: DataFrame, properties: dict) -> DataFrame:
    """The same over a separate (page_id, key, value_json) table."""
    wanted = check_properties(properties)
    if not wanted:
        return pages
    condition = F.lit(False)
    for key, value in wanted.items():
        condition = condition | ((F.col("key") == key) & (F.col("value_json") == value))
    matching = page_properties.filter(condition).groupBy("page_id").agg(F.count_distinct("key").alias("found")).filter(F.col("found") == len(wanted))
    return pages.join(matching, pages["id"] == matching["page_id"], "left_semi")


def property_rows(pages: DataFrame) -> DataFrame:
    """(page_id, key, value_json, value_text) of every property."""
    rows = pages.select(F.col("id").alias("page_id"), F.explode("properties").alias("key", "value_json"))
    return rows.withColumn("value_text", json_text("value_json"))


def json_text(value_json: str | Column) -> Column:
    """Plain text of a JSON scalar."""
    value = F.col(value_json) if isinstance(value_json, str) else value_json
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(value.startswith('"'), quoted).otherwise(value)


def tag_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("id").alias("page_id"), F.explode("tags").alias("tag"))


def in_interval(df: DataFrame, column: str, after: str | None, before: str | None) -> DataFrame:
    """Half-open interval: from `after` inclusive to `before` exclusive."""
    kind = df.schema[column].dataType
    if after is not None:
        df = df.filter(F.col(column) >= F.lit(after).cast(kind))
    if before is not None:
        df = df.filter(F.col(column) < F.lit(before).cast(kind))
    return df


def current_versions(versions: DataFrame, document: str = "document_id", version: str = "version") -> DataFrame:
    return latest_per(versions, document, F.col(version).desc())


def searchable_sections(sections: DataFrame, versions: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections of the current version of every ready document on a live page.

    Versions, documents and pages meet first, without texts; the sections move once.
    """
    ready = documents.filter(F.col("status") == "ready").select(
        F.col("id").alias("document_id"), "page_id", "filename", "format", "ocr_status", F.col("updated_at").alias("document_updated_at")
    )
    live = active(pages).select(F.col("id").alias("page_id"), F.col("title").alias("page_title"), F.col("status").alias("page_status"), F.col("tags"), F.col("properties"))
    current = current_versions(versions.select(F.col("id").alias("version_id"), "document_id", "version"))
    return sections.join(current.join(ready.join(live, "page_id"), "document_id"), "version_id")


def with_facets(sections: DataFrame, filters: SectionFilters, tags: list[str] = (), status: str = "all", properties: dict | None = None) -> DataFrame:
    """Every facet of a section search, before any ranking."""
    result = with_status(sections, status, "page_status")
    result = with_properties(with_all_tags(result, list(tags)), properties or {})
    equal = {
        "document_id": filters.document_id,
        "format": filters.format,
        "version": filters.version,
        "ocr_status": filters.ocr_status,
        "hidden": filters.hidden,
        "kind": filters.kind,
    }
    for column, value in equal.items():
        if value is not None:
            result = result.filter(F.col(column) == value)
    if filters.document_ids:
        result = result.filter(F.col("document_id").isin(list(filters.document_ids)))
    return in_interval(result, "document_updated_at", filters.updated_after, filters.updated_before)


def check_search_request(query: str, tags: list[str], properties: dict, filters: SectionFilters) -> tuple[bool, bool]:
    """Whether pages and sections take part; refuses a search without any criterion."""
    given = bool(query.strip() or tags or properties)
    if not given and filters.source != "documents" and not filters.active:
        raise RequestError("empty_search", "search text or a compatible filter is required")
    return filters.pages_eligible and given, filters.source != "pages"


def page_by_id(pages: DataFrame, page_id: int) -> DataFrame:
    if type(page_id) is not int or page_id < 0:
        raise RequestError("invalid_id", "page ID is invalid")
    return active(pages).filter(F.col("id") == page_id)


def page_by_alias(pages: DataFrame, alias: str) -> DataFrame:
    from ..functions.text import check_alias

    return active(pages).filter(F.col("alias") == check_alias(alias))


def deleted_by_alias(pages: DataFrame, alias: str) -> DataFrame:
    """The most recently created of the deleted pages that had this alias."""
    from ..functions.text import check_alias

    return deleted(pages).filter(normalize_alias(F.col("deleted_alias")) == check_alias(alias)).orderBy(F.desc("id")).limit(1)
