"""From a question to numbered evidence, over pages and document sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.citations import page_url, section_url
from ..model import CANDIDATES_PER_LIST, RRF_CONSTANT, SectionFilters
from ..session import written
from . import hybrid
from .evidence import build_evidence
from .filters import active, check_search_request, with_all_tags, with_facets, with_properties, with_status
from .lexical import PAGE_TEXTS, SECTION_TEXTS, bm25_part, count_matches, inverse_frequency, page_index_rows, question_keywords, section_index_rows
from .scale import top_per_group

EMPTY_HITS = "hit string, page_id long, rank int"


def keywords_of(spark, question: str) -> list[str]:
    """Up to twelve distinct words of a question, in order."""
    asked = spark.range(1).select(F.lit(question).alias("text"))
    return [row["keyword"] for row in question_keywords(asked).orderBy("keyword_no").collect()]


def keyword_scores(rows: DataFrame, texts: list[str], keywords: list[str], keep: list[str]) -> DataFrame:
    """(keyword_no, kept columns, score) of every row that holds a keyword as a prefix.

    All keywords are counted in one pass over the texts; rows without any are not written.
    """
    seen, places = Observation(), range(len(keywords))
    counted = count_matches(rows, texts, [[keyword] for keyword in keywords], keep).observe(
        seen, F.count(F.lit(1)).alias("total"), F.sum(F.col("length").cast("long")).alias("tokens"), *[F.count_if(F.col(f"hits_{at}") > 0).alias(f"containing_{at}") for at in places]
    )
    some = F.greatest(*[F.col(f"hits_{at}") for at in places], F.lit(0)) > 0
    matching = written(counted.filter(some))
    corpus = seen.get
    total, average = F.lit(corpus["total"]), F.lit((corpus["tokens"] or 0) / max(1, corpus["total"]))
    parts = [F.struct(F.lit(at).alias("keyword_no"), F.col(f"hits_{at}").alias("hits"), F.lit(corpus[f"containing_{at}"]).alias("containing")) for at in places]
    each = matching.select(*keep, "length", F.inline(F.array(*parts))).filter("hits > 0")
    return each.select("keyword_no", *keep, (-inverse_frequency(total, F.col("containing")) * bm25_part(F.col("hits"), F.col("length"), average)).alias("score"))


def vote(pages: DataFrame, searchable: DataFrame | None, question: str, tags: list[str], status: str, properties: dict, filters: SectionFilters, limit: int) -> DataFrame:
    """(hit, page_id, rank): every keyword searched on its own with all filters; hits in order of the keywords that found them.

    Ties go to the better single rank, then to the hit that an earlier keyword found first.
    """
    keywords = keywords_of(pages.sparkSession, question)
    if not keywords:
        return pages.sparkSession.createDataFrame([], EMPTY_HITS)
    with_pages, with_sections = check_search_request(question, tags, properties, filters)
    lists = []
    if with_pages:
        scored = keyword_scores(page_index_rows(active(pages)), PAGE_TEXTS, keywords, ["id", "status", "tags", "properties"])
        kept = with_properties(with_all_tags(with_status(scored, status), tags), properties)
        best = top_per_group(kept, "keyword_no", CANDIDATES_PER_LIST, F.asc("score"), F.desc("id"))
        lists.append(best.select("keyword_no", F.concat(F.lit("p:"), F.col("id").cast("string")).alias("hit"), F.col("id").alias("page_id"), "rank"))
    if with_sections and searchable is not None:
        facets = ["section_id", "page_id", "document_id", "version", "format", "kind", "hidden", "ocr_status", "document_updated_at", "page_status", "tags", "properties"]
        scored = keyword_scores(section_index_rows(searchable), SECTION_TEXTS, keywords, facets)
        best = top_per_group(with_facets(scored, filters, tags, status, properties), "keyword_no", CANDIDATES_PER_LIST, F.asc("score"), F.desc("section_id"))
        lists.append(best.select("keyword_no", F.concat(F.lit("d:"), F.col("section_id").cast("string")).alias("hit"), "page_id", "rank"))
    if not lists:
        return pages.sparkSession.createDataFrame([], EMPTY_HITS)
    union = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    scores = union.groupBy("keyword_no", "hit", "page_id").agg(F.sum(1 / (F.lit(RRF_CONSTANT) + F.col("rank"))).alias("score"))
    # At most two hundred hits for each of twelve keywords.
    is_section = F.col("hit").startswith("d:")
    marked = scores.withColumn("_found", F.max(is_section).over(Window.partitionBy("keyword_no", "page_id")))
    fused = top_per_group(marked.filter(is_section | ~F.col("_found")).withColumn("_key", F.round("score", 12)), "keyword_no", limit, F.desc("_key"), F.asc("hit"))
    votes = fused.groupBy("hit", "page_id").agg(F.count("*").alias("votes"), F.min("rank").alias("best"), F.min(F.struct("keyword_no", "rank")).alias("first"))
    top = votes.orderBy(F.desc("votes"), "best", "first").limit(limit)
    return top.select("hit", "page_id", F.row_number().over(Window.orderBy(F.desc("votes"), "best", "first")).alias("rank"))


def retrieve(
    pages: DataFrame, searchable: DataFrame | None, question: str, tags: list[str] = (), status: str = "published", properties: dict | None = None, filters: SectionFilters = SectionFilters(), limit: int = 4,
    vector: list[float] | None = None, page_chunks: DataFrame | None = None, section_chunks: DataFrame | None = None,
) -> tuple[DataFrame, str, str | None]:
    """Hits for a question, (hit, page_id, rank), the mode that found them, and a warning if any.

    The whole question is searched first, with vectors if there are any. When words
    alone find nothing, its keywords are searched one by one.
    """
    if searchable is None:
        filters = SectionFilters(source="pages")
    found, mode, warning = hybrid.search(pages, searchable, question, list(tags), status, properties, filters, vector, page_chunks, section_chunks)
    top = written(found.limit(limit))
    ranked = top.select("hit", "page_id", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "hit")).alias("rank"))
    if mode == "hybrid" or top.limit(1).count():
        return ranked, mode, warning
    return vote(pages, searchable, question, list(tags), status, properties or {}, filters, limit), "keywords", warning


def evidence(hits: DataFrame, pages: DataFrame, searchable: DataFrame | None, max_items: int = 4, item_chars: int = 3500, total_chars: int = 50_000) -> DataFrame:
    """Numbered evidence of ranked hits: source, title, locator, url, content and excerpt.

    The hits are one short list, so they are broadcast to the tables with the texts.
    """
    few = F.broadcast(hits)
    live = active(pages).select(F.concat(F.lit("p:"), F.col("id").cast("string")).alias("hit"), F.lit("page").alias("source"), "title", F.col("alias").alias("locator"), page_url(F.col("alias")).alias("url"), F.col("body").alias("text"))
    rows = live.join(few.select("hit", "rank"), "hit")
    if searchable is not None:
        parts = searchable.select(
            F.concat(F.lit("d:"), F.col("section_id").cast("string")).alias("hit"), F.lit("document").alias("source"), F.col("filename").alias("title"), F.col("locator.label").alias("locator"), section_url(F.col("document_id"), F.col("ordinal")).alias("url"), "text"
        )
        rows = rows.unionByName(parts.join(few.select("hit", "rank"), "hit"))
    return build_evidence(rows.withColumn("question", F.lit(1)), "question", "rank", "text", max_items, item_chars, total_chars).drop("question")
