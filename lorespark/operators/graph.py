"""Links between pages, shared tags, and overview lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cursors import strict_limit
from ..functions.text import wiki_links
from ..model import MAX_EXPLORE_SIZE
from .filters import active, deleted
from .scale import latest_per, sum_before


def by_time() -> list:
    """Order of overview lists after their own key."""
    return [F.desc("updated_at"), F.lower("title"), F.col("id")]


def fetched(pages: DataFrame, few: DataFrame) -> DataFrame:
    """The pages of a short list (at most MAX_EXPLORE_SIZE ids), with the list's other columns."""
    return pages.join(F.broadcast(few), "id")


def link_rows(pages: DataFrame) -> DataFrame:
    """(source_page_id, target_alias) of every wiki link."""
    return pages.select(F.col("id").alias("source_page_id"), F.explode(wiki_links(F.col("body"))).alias("target_alias"))


def link_states(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each link leads: an active page, the last deleted page of that alias, or nowhere.

    Both lookups are unique per alias, so a popular target multiplies nothing;
    adaptive execution splits its rows.
    """
    live = active(pages).select(F.col("alias").alias("target_alias"), F.col("id").alias("active_id"), F.col("title").alias("active_title"))
    gone = latest_per(deleted(pages), "deleted_alias", F.desc("deleted_at"), F.desc("id")).select(
        F.col("deleted_alias").alias("target_alias"), F.col("id").alias("deleted_id"), F.col("title").alias("deleted_title")
    )
    joined = links.join(live, "target_alias", "left").join(gone, "target_alias", "left")
    return joined.select(
        "source_page_id",
        F.col("target_alias").alias("alias"),
        F.coalesce("active_id", "deleted_id").alias("id"),
        F.when(F.col("active_id").isNotNull(), F.col("active_title")).otherwise(F.col("deleted_title")).alias("title"),
        F.when(F.col("active_id").isNotNull(), F.lit("active")).when(F.col("deleted_id").isNotNull(), F.lit("deleted")).otherwise(F.lit("missing")).alias("state"),
    )


def outgoing_links(links: DataFrame, pages: DataFrame, page_id: int) -> DataFrame:
    return link_states(links.filter(F.col("source_page_id") == page_id), pages).orderBy("alias")


def backlinks(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, source_id, source_title, source_alias): live sources of every live page."""
    target = active(pages).select(F.col("id").alias("page_id"), F.col("alias").alias("target_alias"))
    source = active(pages).select(F.col("id").alias("source_page_id"), F.col("title").alias("source_title"), F.col("alias").alias("source_alias"))
    return links.join(target, "target_alias").join(source, "source_page_id").select("page_id", F.col("source_page_id").alias("source_id"), "source_title", "source_alias")


def backlink_list(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, position, id, title, alias): the live pages that name each page, by title, from 1.

    A page in the trash keeps those of the alias it had. Rows, not an array: a page may be named by any share of all pages.
    """
    target = pages.select(F.col("id").alias("page_id"), F.when(F.col("deleted_at").isNull(), F.col("alias")).otherwise(F.coalesce("deleted_alias", "alias")).alias("target_alias"))
    source = active(pages).select(F.col("id").alias("source_page_id"), "title", "alias")
    named = links.distinct().join(target, "target_alias").join(source, "source_page_id").select("page_id", F.col("source_page_id").alias("id"), "title", "alias")
    placed = sum_before(named.withColumns({"_name": F.lower("title"), "_one": F.lit(1)}), "page_id", ["_name", "id"], "_one", "_before")
    return placed.select("page_id", (F.col("_before") + 1).alias("position"), "id", "title", "alias")


def incoming_counts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(alias, incoming_links): number of distinct live sources per target alias.

    The sources are filtered and made distinct before the targets are counted,
    so the shuffle on the alias carries partial counts only.
    """
    live_sources = active(pages).select(F.col("id").alias("source_page_id"))
    distinct_links = links.select("source_page_id", "target_alias").distinct().join(live_sources, "source_page_id", "left_semi")
    return distinct_links.groupBy(F.col("target_alias").alias("alias")).agg(F.count("*").alias("incoming_links"))


def most_linked(links: DataFrame, pages: DataFrame, limit: int = 10) -> DataFrame:
    """Ranked on narrow rows; the bodies of the few that stay come afterwards."""
    narrow = active(pages).select("id", "alias", "title", "updated_at")
    best = narrow.join(incoming_counts(links, pages), "alias").orderBy(F.desc("incoming_links"), *by_time()).limit(strict_limit(limit, MAX_EXPLORE_SIZE))
    return fetched(pages, best.select("id", "incoming_links")).orderBy(F.desc("incoming_links"), *by_time())


def unconnected(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, alias, title, updated_at) of live root pages that no live page links to."""
    roots = active(pages).filter(F.col("parent_id").isNull()).select("id", "alias", "title", "updated_at")
    return roots.join(incoming_counts(links, pages).select("alias"), "alias", "left_anti")


def explore(links: DataFrame, pages: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    size = strict_limit(limit, MAX_EXPLORE_SIZE)
    roots = unconnected(links, pages).orderBy(*by_time()).limit(size)
    return {
        "recent": active(pages).orderBy(F.desc("updated_at"), F.desc("id")).limit(size),
        "most_linked": most_linked(links, pages, size),
        "unconnected": fetched(pages, roots.select("id")).orderBy(*by_time()),
    }


def children(pages: DataFrame, page_id: int) -> DataFrame:
    """Live children of any status, by title."""
    return active(pages).filter(F.col("parent_id") == page_id).orderBy(F.lower("title"), "id")


def related(pages: DataFrame, page_id: int, limit: int = 8) -> DataFrame:
    """Live pages of any status that share tags with one page.

    The page's own tag list (at most fifty) is a scalar subquery; every other
    page intersects its own list with it, so nothing is exploded or joined.
    """
    own = active(pages).filter(F.col("id") == page_id).select("tags").scalar()
    shared = active(pages).filter(F.col("id") != page_id).withColumn("shared_tags", F.array_intersect("tags", own))
    counted = shared.withColumn("shared_count", F.size("shared_tags")).filter(F.col("shared_count") > 0)
    return counted.orderBy(F.desc("shared_count"), F.desc("updated_at"), F.lower("title"), "id").limit(strict_limit(limit, MAX_EXPLORE_SIZE))


def related_by_edges(page_tags: DataFrame, pages: DataFrame, page_id: int, limit: int = 8) -> DataFrame:
    """The same over a (page_id, tag) table: one page's tags against all others, partial counts first."""
    mine = page_tags.filter(F.col("page_id") == page_id).select("tag")
    others = page_tags.filter(F.col("page_id") != page_id).join(mine, "tag", "left_semi")
    counts = others.groupBy("page_id").agg(F.count("*").alias("shared_count"), F.array_sort(F.collect_set("tag")).alias("shared_tags"))
    narrow = active(pages).select("id", "title", "updated_at").join(counts.withColumnRenamed("page_id", "id"), "id")
    best = narrow.orderBy(F.desc("shared_count"), *by_time()).limit(strict_limit(limit, MAX_EXPLORE_SIZE))
    return fetched(pages, best.select("id", "shared_count", "shared_tags")).withColumn("page_id", F.col("id")).orderBy(F.desc("shared_count"), *by_time())


def pages_for_tag(pages: DataFrame, tag: str) -> DataFrame:
    live = active(pages).filter(F.col("status") == "published")
    return live.filter(F.array_contains("tags", tag.strip().lower())).orderBy(F.desc("updated_at"), F.desc("id"))
