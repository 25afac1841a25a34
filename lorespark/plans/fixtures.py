"""The archive's tables over the given Parquet tables, for Spark and as SQL text.

Each adapter has a SQL twin, so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_spread, read_table


def wiki(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages.

    A document rated 0 is a draft, a toxic one lies in the trash. Pages form a
    forest in which page n hangs below page n / 10.
    """
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text", "lang", "source", "n_chars")
    labels = read_table(spark, folder, "labels")
    ident = F.col("doc_id")
    joined = documents.join(labels, "doc_id", "left")
    gone = F.coalesce(F.col("toxic") == 1, F.lit(False))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    updated = F.timestamp_add("SECOND", F.col("n_chars") * 61 + ident, start)
    alias = F.concat(F.lit("doc-"), ident.cast("string"))
    return joined.select(
        ident.alias("id"),
        F.regexp_replace(F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){0,5})", 1), r"\s+", " ").alias("title"),
        F.when(gone, F.concat(F.lit("deleted-page-"), ident.cast("string"))).otherwise(alias).alias("alias"),
        F.col("text").alias("body"),
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")).alias("tags"),
        F.when(F.col("quality") == 0, F.lit("draft")).otherwise(F.lit("published")).alias("status"),
        F.when(ident > 0, F.floor(ident / 10)).cast("bigint").alias("parent_id"),
        F.create_map(F.lit("chars"), F.col("n_chars").cast("string"), F.lit("lang"), F.concat(F.lit('"'), "lang", F.lit('"'))).alias("properties"),
        F.timestamp_add("SECOND", ident, start).alias("created_at"),
        updated.alias("updated_at"),
        F.when(gone, F.timestamp_add("DAY", F.lit(1), updated)).alias("deleted_at"),
        F.when(gone, alias).alias("deleted_alias"),
    )


WIKI = r"""wiki AS (
  SELECT d.doc_id AS id,
    array_to_string(list_slice(string_split(trim(regexp_replace(d.text, '\s+', ' ', 'g')), ' '), 1, 6), ' ') AS title,
    CASE WHEN coalesce(l.toxic = 1, false) THEN 'deleted-page-' || d.doc_id ELSE 'doc-' || d.doc_id END AS alias,
    d.text AS body, d.lang AS lang, d.source AS source, d.n_chars AS n_chars,
    ['lang:' || d.lang, 'source:' || d.source] AS tags,
    CASE WHEN l.quality = 0 THEN 'draft' ELSE 'published' END AS status,
    CASE WHEN d.doc_id > 0 THEN d.doc_id // 10 END AS parent_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.n_chars * 61 + d.doc_id) AS updated_at,
    CASE WHEN coalesce(l.toxic = 1, false) THEN TIMESTAMP '2024-01-02 00:00:00' + to_seconds(d.n_chars * 61 + d.doc_id) END AS deleted_at,
    CASE WHEN coalesce(l.toxic = 1, false) THEN 'doc-' || d.doc_id END AS deleted_alias
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def text_of_time(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def archive_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as documents: one file per conversation on the page of the same number."""
    turns = read_spread(spark, folder, "conversations", "conv_id").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    conv = F.col("conv_id")
    return turns.select(
        conv.alias("id"),
        conv.alias("page_id"),
        F.concat(F.lit("talk-"), conv.cast("string"), F.when(conv % 2 == 0, F.lit(".md")).otherwise(F.lit(".txt"))).alias("filename"),
        F.when(conv % 2 == 0, F.lit("markdown")).otherwise(F.lit("text")).alias("format"),
        F.when(conv % 7 == 0, F.lit("queued")).otherwise(F.lit("ready")).alias("status"),
        F.when(conv % 5 == 0, F.lit("pending")).otherwise(F.lit("not_required")).alias("ocr_status"),
        F.timestamp_add("HOUR", conv, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).alias("updated_at"),
    )


def document_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions per conversation: an empty first one, and the current one."""
    conv = read_spread(spark, folder, "conversations", "conv_id").select("conv_id").distinct()
    return conv.select(F.col("conv_id").alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).select(
        (F.col("document_id") * 2 + F.col("version")).alias("id"), "document_id", "version"
    )


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as sections of the current version; system turns are hidden."""
    turns = read_spread(spark, folder, "conversations", "conv_id")
    label = F.concat(F.lit("Turn "), F.col("turn").cast("string"))
    none = F.lit(None)
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("section_id"),
        (F.col("conv_id") * 2 + 2).alias("version_id"),
        F.col("turn").alias("ordinal"),
        F.when(F.col("role") == "user", F.lit("heading")).otherwise(F.lit("paragraph")).alias("kind"),
        F.col("role").alias("title"),
        F.struct(
            label.alias("label"), none.cast("int").alias("page"), none.cast("int").alias("slide"), none.cast("string").alias("sheet"),
            none.cast("string").alias("range"), none.cast("string").alias("heading"), none.cast("string").alias("image"), F.col("role").alias("part"),
        ).alias("locator"),
        "text",
        (F.col("role") == "system").alias("hidden"),
    )


SECTIONS = r"""searchable AS (
  SELECT c.conv_id * 1000 + c.turn AS section_id, c.conv_id AS document_id, c.conv_id AS page_id, c.turn AS ordinal,
    'talk-' || c.conv_id || CASE WHEN c.conv_id % 2 = 0 THEN '.md' ELSE '.txt' END AS filename,
    CASE WHEN c.conv_id % 2 = 0 THEN 'markdown' ELSE 'text' END AS format,
    CASE WHEN c.conv_id % 5 = 0 THEN 'pending' ELSE 'not_required' END AS ocr_status,
    TIMESTAMP '2024-03-01 00:00:00' + to_hours(c.conv_id) AS document_updated_at,
    CASE WHEN c.role = 'user' THEN 'heading' ELSE 'paragraph' END AS kind, c.role AS title, 'Turn ' || c.turn AS label,
    c.role = 'system' AS hidden, c.text AS text, w.title AS page_title, w.status AS page_status, w.tags AS tags, 2 AS version,
    '{"label":"Turn ' || c.turn || '","part":"' || c.role || '"}' AS locator_text
  FROM conversations c JOIN wiki w ON w.id = c.conv_id
  WHERE c.conv_id % 7 <> 0 AND w.deleted_at IS NULL)"""


def queue_events(spark: SparkSession, folder: str) -> DataFrame:
    """User events as job events: signup requests, view claims, click renews, error fails, purchase completes."""
    events = read_table(spark, folder, "events")
    kinds = {"signup": "requested", "view": "claimed", "click": "renewed", "error": "failed", "purchase": "completed"}
    kind = F.lit(None).cast("string")
    for event_type, name in kinds.items():
        kind = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(kind)
    return events.select(
        F.col("user_id").alias("entity_id"), F.col("ts").alias("at"), "event_id", kind.alias("kind"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("worker-"), (F.col("event_id") % 7).cast("string"))).alias("owner"),
    )


def link_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and parts as pages, for the link graph of order lines.

    Large parts lie in the trash.
    """
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    parts = read_table(spark, folder, "part")
    gone = F.col("p_size") >= 40
    alias = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    part_pages = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.when(gone, F.concat(F.lit("deleted-page-"), F.col("p_partkey").cast("string"))).otherwise(alias).alias("alias"),
        F.lit(None).cast("bigint").alias("parent_id"),
        F.timestamp_add("SECOND", F.col("p_size"), moment).alias("updated_at"),
        F.when(gone, moment).alias("deleted_at"), F.when(gone, alias).alias("deleted_alias"),
    )
    orders = read_table(spark, folder, "orders")
    order_pages = orders.select(
        (F.lit(1_000_000_000) + F.col("o_orderkey")).alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("alias"), F.lit(None).cast("bigint").alias("parent_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("deleted_alias"),
    )
    return part_pages.unionByName(order_pages)


def order_links(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as links from an order page to part aliases, each pair once; lines of 50 pieces name pages that were never written."""
    lines = read_table(spark, folder, "lineitem")
    named = F.concat(F.when(F.col("l_quantity") == 50, F.lit("lost-")).otherwise(F.lit("part-")), F.col("l_partkey").cast("string"))
    return lines.select((F.lit(1_000_000_000) + F.col("l_orderkey")).alias("source_page_id"), named.alias("target_alias")).distinct()


LINKS = """linkpages AS (
  SELECT p_partkey AS id, p_name AS title,
    CASE WHEN p_size >= 40 THEN 'deleted-page-' || p_partkey ELSE 'part-' || p_partkey END AS alias,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_size) AS updated_at,
    CASE WHEN p_size >= 40 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at,
    CASE WHEN p_size >= 40 THEN 'part-' || p_partkey END AS deleted_alias
  FROM part
  UNION ALL
  SELECT 1000000000 + o_orderkey, 'Order ' || o_orderkey, 'order-' || o_orderkey, o_orderdate,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate END, CASE WHEN o_orderstatus = 'P' THEN 'order-' || o_orderkey END
  FROM orders),
links AS (SELECT DISTINCT 1000000000 + l_orderkey AS source_page_id, CASE WHEN l_quantity = 50 THEN 'lost-' ELSE 'part-' END || l_partkey AS target_alias FROM lineitem)"""
