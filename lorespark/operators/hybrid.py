"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cursors import strict_limit, decode_hybrid, encode_hybrid, fingerprint
from ..functions.text import check_tags
from ..model import CANDIDATES_PER_LIST, RRF_CONSTANT, RequestError, SectionFilters
from .filters import check_properties, check_search_request, with_all_tags, with_properties
from .lexical import page_order, rank_pages, rank_sections, section_order
from .vectors import page_neighbours, section_neighbours


def page_list(ranked: DataFrame, page_id: str = "id") -> DataFrame:
    """A ranked page list as (hit, page_id, rank)."""
    return ranked.select(F.concat(F.lit("p:"), F.col(page_id).cast("string")).alias("hit"), F.col(page_id).alias("page_id"), "rank")


def section_list(ranked: DataFrame, section_id: str = "section_id") -> DataFrame:
    """A ranked section list as (hit, page_id, rank)."""
    return ranked.select(F.concat(F.lit("d:"), F.col(section_id).cast("string")).alias("hit"), "page_id", "rank")


def with_rank(top: DataFrame, *order) -> DataFrame:
    """Number a list that is already cut to at most one hundred rows."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def first_per_section(neighbours: DataFrame) -> DataFrame:
    """A section counts once, at the rank of its nearest chunk; later ranks keep their gaps."""
    return neighbours.groupBy("section_id", "page_id").agg(F.min("rank").alias("rank"))


def fuse(lists: list[DataFrame]) -> DataFrame:
    """Sum of 1 / (60 + rank) per hit, best first; equal scores are ordered by the hit key."""
    union = reduce(DataFrame.unionByName, lists)
    scores = union.groupBy("hit", "page_id").agg(F.sum(1 / (F.lit(RRF_CONSTANT) + F.col("rank"))).alias("score"))
    return without_linked_pages(scores).orderBy(F.round("score", 12).desc(), "hit")


def without_linked_pages(scores: DataFrame) -> DataFrame:
    """Drop a page whose own document section was found. At most four hundred hits, so one small window does it."""
    is_section = F.col("hit").startswith("d:")
    marked = scores.withColumn("_found", F.max(is_section).over(Window.partitionBy("page_id")))
    return marked.filter(is_section | ~F.col("_found")).drop("_found")


def lexical_lists(pages: DataFrame, searchable: DataFrame, query: str, tags: list[str], status: str, properties: dict, filters: SectionFilters) -> list[DataFrame]:
    with_pages, with_sections = check_search_request(query, tags, properties, filters)
    lists = []
    if with_pages:
        top = rank_pages(pages, query, tags, status, properties, CANDIDATES_PER_LIST)
        lists.append(page_list(with_rank(top, *page_order(query))))
    if with_sections:
        top = rank_sections(searchable, query, filters, tags, status, properties, CANDIDATES_PER_LIST)
        lists.append(section_list(with_rank(top, *section_order(query))))
    return lists


def vector_lists(
    page_chunks: DataFrame, section_chunks: DataFrame, pages: DataFrame, searchable: DataFrame, vector: list[float], tags: list[str], status: str, properties: dict, filters: SectionFilters, strict_prefilter: bool = False, model: str | None = None
) -> list[DataFrame]:
    """Page chunks are filtered by tag and property after the top hundred, and each chunk adds to its page.

    `strict_prefilter` filters first instead. `model` is the one that made the
    question's vector: chunks of another one take no part.
    """
    lists = []
    if filters.pages_eligible:
        matching = with_properties(with_all_tags(pages, tags), properties)
        candidates = matching if strict_prefilter else pages
        near = page_neighbours(page_chunks, candidates, vector, status, model=model)
        kept = near.join(matching.select(F.col("id").alias("page_id")), "page_id", "left_semi")
        lists.append(page_list(kept, "page_id"))
    if filters.source != "pages":
        near = section_neighbours(section_chunks, searchable, vector, filters, tags, status, properties, model=model)
        lists.append(section_list(first_per_section(near)))
    return lists


def search(
    pages: DataFrame,
    searchable: DataFrame,
    query: str,
    tags: list[str] = (),
    status: str = "published",
    properties: dict | None = None,
    filters: SectionFilters = SectionFilters(),
    vector: list[float] | None = None,
    page_chunks: DataFrame | None = None,
    section_chunks: DataFrame | None = None,
    model: str | None = None,
) -> tuple[DataFrame, str, str | None]:
    """Fused hits, the mode that was used, and a warning when vectors were wanted but missing.

    Chunk tables with a column `model` ask for the model of the question's vector.
    """
    tags, properties = check_tags(list(tags)), properties or {}
    check_properties(properties)
    lists = lexical_lists(pages, searchable, query, tags, status, properties, filters)
    if not query.strip() or vector is None:
        return fuse(lists), "lexical", None
    if page_chunks is None or section_chunks is None:
        return fuse(lists), "lexical", "Semantic index is unavailable or empty; lexical results are shown."
    if model is None and ("model" in page_chunks.columns or "model" in section_chunks.columns):
        raise RequestError("the model of the question's vector is needed")
    lists += vector_lists(page_chunks, section_chunks, pages, searchable, vector, tags, status, properties, filters, model=model)
    return fuse(lists), "hybrid", None


def take_hits(hits: DataFrame, cursor: str | None, limit: int, mode: str, **request) -> tuple[list, str | None]:
    """One page of fused hits; the cursor is bound to the request."""
    mark = fingerprint(mode=mode, **request)
    offset, size = decode_hybrid(cursor, mark), strict_limit(limit)
    rows = hits.offset(offset).take(size + 1)
    return rows[:size], encode_hybrid(offset + size, mark) if len(rows) > size else None
