"""Attachments, whole pages, lookups, captures, index upkeep, requests and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cursors, html, text
from ..model import RequestError, SectionFilters
from ..operators import answering, attachments, blobs, captures, chunks, documents, filters, graph, hybrid, queues
from ..sources import frontmatter
from ..sources.tables import read_spread, read_table, upsert
from .fixtures import SECTIONS, TIME, WIKI, archive_documents, document_versions, queue_events, sections, text_of_time, wiki
from .reading import searchable
from .search import RRF, two_rankings
from .state import CAPTURES, JOB_BACKOFF, NOW, capture_rows, fold_sql

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def page_files(spark, folder):
    """Documents as files: each on the page a quarter of its number, named by source and language, content its text."""
    rows = read_spread(spark, folder, "documents", "doc_id")
    return rows.select(
        F.col("doc_id").alias("no"), F.floor(F.col("doc_id") / 4).alias("page_id"), F.concat(F.when(F.col("n_chars") % 11 == 0, F.lit("../")).otherwise(F.lit("")), "source", F.lit("."), "lang").alias("filename"), F.lit("text/plain").alias("mime"), F.encode("text", "UTF-8").alias("content"),
    )


FILES = f"""{WIKI}, files AS (SELECT doc_id AS no, doc_id // 4 AS page_id, CASE WHEN n_chars % 11 = 0 THEN '../' ELSE '' END || source || '.' || lang AS filename, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents),
    checked AS (SELECT *, CASE WHEN page_id NOT IN (SELECT id FROM wiki WHERE deleted_at IS NULL) THEN 'page not found' WHEN filename LIKE '../%' THEN 'attachment filename is invalid'
      WHEN no > min(no) OVER (PARTITION BY page_id, filename) THEN 'attachment already exists on this page' END AS error FROM files),
    stored AS (SELECT sha256, max(size) AS size FROM checked WHERE error IS NULL GROUP BY sha256)"""


def attached(spark, folder):
    none = spark.createDataFrame([], "page_id long, filename string")
    return attachments.attach(page_files(spark, folder), none, wiki(spark, folder), "2024-06-01 00:00:00")


@query("attachment_refusals", f"WITH {FILES} SELECT no, error FROM checked WHERE error IS NOT NULL")
def attachment_refusals(spark, folder):
    return attached(spark, folder)["refused"]


@query("attachments_of_pages", f"WITH {FILES} SELECT no AS id, page_id, filename, s.size, substr(sha256, 1, 2) || '/' || sha256 AS path FROM checked JOIN stored s USING (sha256) WHERE error IS NULL")
def attachments_of_pages(spark, folder):
    made = attached(spark, folder)
    rows = attachments.listed(made["attachments"].withColumnRenamed("no", "id"), made["blobs"], wiki(spark, folder))
    return rows.select("id", "page_id", "filename", "size", "path")


@query(
    "attachment_removal",
    f"""WITH {FILES}, kept AS (SELECT * FROM checked WHERE error IS NULL AND size % 3 <> 0)
    SELECT DISTINCT sha256 FROM checked WHERE error IS NULL AND size % 3 = 0 AND sha256 NOT IN (SELECT sha256 FROM kept) AND sha256 NOT IN (SELECT sha256(text) FROM benchmark)""",
)
def attachment_removal(spark, folder):
    """Blobs that nothing refers to after every attachment of a size divisible by three went."""
    made = attached(spark, folder)
    rows = made["attachments"].withColumnRenamed("no", "id")
    chosen = rows.join(made["blobs"].filter(F.col("size") % 3 == 0), F.col("blob_sha256") == F.col("sha256"), "left_semi").select("id")
    others = blobs.addressed(read_table(spark, folder, "benchmark"), "text").select("sha256")
    return attachments.remove(rows, chosen, wiki(spark, folder), made["blobs"], others)["orphans"].select("sha256")


@query(
    "page_reading",
    f"""WITH RECURSIVE {WIKI}, live AS (SELECT * FROM wiki WHERE deleted_at IS NULL), up AS (SELECT id, parent_id AS at, '' AS path FROM live
      UNION ALL SELECT u.id, l.parent_id, l.title || '/' || u.path FROM up u JOIN live l ON l.id = u.at),
    links AS (SELECT id AS source, 'doc-' || (n_chars % 200) AS target FROM wiki)
    SELECT l.id, l.title, coalesce(arg_max(u.path, length(u.path)), '') AS crumbs, l.lang || ',' || l.n_chars AS properties,
      (SELECT count(*) FROM live c WHERE c.parent_id = l.id) AS children, (SELECT count(DISTINCT k.source) FROM links k JOIN live s ON s.id = k.source WHERE k.target = l.alias) AS backlinks
    FROM live l JOIN up u ON u.id = l.id GROUP BY l.id, l.title, l.lang, l.n_chars, l.alias""",
)
def page_reading(spark, folder):
    """Every live page with breadcrumbs, children, properties as text, and the pages that name it."""
    pages = wiki(spark, folder)
    links = pages.select(F.col("id").alias("source_page_id"), F.concat(F.lit("doc-"), (F.expr("cast(properties['chars'] as bigint)") % 200).cast("string")).alias("target_alias"))
    rows = attachments.hydrate_pages(pages, links)
    crumbs = F.array_join(F.transform("breadcrumbs", lambda item: F.concat(item["title"], F.lit("/"))), "")
    return rows.select("id", "title", crumbs.alias("crumbs"), F.concat_ws(",", F.col("properties_text")["lang"], F.col("properties_text")["chars"]).alias("properties"), "children", F.col("backlink_count").alias("backlinks"))


@query(
    "page_backlinks",
    f"""WITH {WIKI}, links AS (SELECT DISTINCT id AS source, 'doc-' || (n_chars % 200) AS target FROM wiki)
    SELECT t.id AS page_id, row_number() OVER (PARTITION BY t.id ORDER BY lower(s.title) NULLS FIRST, s.id) AS position, s.id, s.title, s.alias
    FROM links k JOIN wiki s ON s.id = k.source AND s.deleted_at IS NULL JOIN wiki t ON coalesce(t.deleted_alias, t.alias) = k.target""",
)
def page_backlinks(spark, folder):
    """The list of backlinks of every page, live or deleted, in its order."""
    pages = wiki(spark, folder)
    links = pages.select(F.col("id").alias("source_page_id"), F.concat(F.lit("doc-"), (F.expr("cast(properties['chars'] as bigint)") % 200).cast("string")).alias("target_alias"))
    return graph.backlink_list(links, pages)


@query("version_files", "SELECT doc_id AS document_id, sha256(text) AS sha256, substr(sha256(text), 1, 2) || '/' || sha256(text) AS path, octet_length(encode(text)) AS size FROM documents WHERE source <> 'src0'")
def version_files(spark, folder):
    rows = blobs.addressed(read_spread(spark, folder, "documents", "doc_id"), "text")
    stored = rows.filter(F.col("source") != "src0").groupBy("sha256").agg(F.max("size").alias("size")).withColumn("mime_type", F.lit("text/plain"))
    versions = rows.filter(F.col("source") != "src0").select(F.col("doc_id").alias("document_id"), "sha256")
    return attachments.version_files(versions, stored).select("document_id", "sha256", "path", "size")


@query("document_of_page", f"WITH {WIKI} SELECT DISTINCT conv_id AS id, 'talk-' || conv_id || CASE WHEN conv_id % 2 = 0 THEN '.md' ELSE '.txt' END AS filename FROM conversations WHERE conv_id IN (SELECT id FROM wiki WHERE deleted_at IS NULL AND id IN (3, 4, 5, 6, 99999999))")
def document_of_page(spark, folder):
    found = None
    for page_id in (3, 4, 5, 6, 99_999_999):
        one = documents.document_of_page(archive_documents(spark, folder), wiki(spark, folder), page_id)
        found = one if found is None else found.unionByName(one)
    return found.select("id", "filename")


@query(
    "stale_documents",
    "SELECT conv_id AS document_id FROM conversations GROUP BY conv_id HAVING bool_or(length(text) % 97 = 0) OR count(*) % 3 = 0",
)
def stale_documents(spark, folder):
    """Documents with a section that was indexed with another text, or that were never indexed."""
    versions = document_versions(spark, folder).filter("version = 2").withColumn("sha256", F.col("document_id").cast("string"))
    now = sections(spark, folder)
    before = now.withColumn("text", F.when(F.length("text") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    known = now.groupBy("version_id").agg(F.count("*").alias("n")).filter("n % 3 <> 0").select("version_id")
    indexed = chunks.document_hashes(versions, before).join(known, "version_id", "left_semi")
    return chunks.stale_documents(chunks.document_hashes(versions, now), indexed).select("document_id")


@query("vanished_index_rows", f"WITH {WIKI} SELECT vec_id FROM embeddings WHERE vec_id // 2 NOT IN (SELECT id FROM wiki WHERE deleted_at IS NULL)")
def vanished_index_rows(spark, folder):
    rows = read_table(spark, folder, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 2).alias("page_id"))
    live = filters.active(wiki(spark, folder)).select(F.col("id").alias("page_id"))
    return chunks.vanished(rows, "page_id", live).select("vec_id")


def snapshots(spark, folder):
    """Two snapshots for every capture with an odd number of characters, one for the others."""
    pages = read_spread(spark, folder, "pages", "page_id").withColumn("n", F.length("html"))
    return pages.select(
        F.explode(F.sequence(F.lit(0), (F.col("n") % 2).cast("int"))).alias("k"), (F.col("page_id") * 10 + F.col("k")).alias("id"), F.col("page_id").alias("web_capture_id"), (F.col("n") % 3 > 0).alias("assets_captured"), text.sha256_hex(F.col("url")).alias("blob_sha256"),
    ).drop("k")


SNAPSHOTS = "snapshots AS (SELECT page_id * 10 + k AS id, page_id AS web_capture_id, length(html) % 3 > 0 AS assets_captured, sha256(url) AS blob_sha256 FROM pages, (VALUES (0), (1)) AS v(k) WHERE k <= length(html) % 2)"


@query(
    "fetch_jobs",
    f"""WITH {WIKI}, {CAPTURES}, {SNAPSHOTS} SELECT c.id AS web_capture_id, w.title, max(s.id) AS snapshot_id, CASE WHEN bool_or(s.assets_captured) THEN c.etag END AS etag
    FROM captures c JOIN wiki w ON w.id = c.page_id AND w.deleted_at IS NULL JOIN snapshots s ON s.web_capture_id = c.id WHERE c.status IN ('queued', 'fetching') GROUP BY c.id, w.title, c.etag""",
)
def fetch_jobs(spark, folder):
    rows = capture_rows(spark, folder)
    jobs = rows.filter(F.col("status").isin("queued", "fetching")).select(F.col("id").alias("web_capture_id"))
    found = captures.fetch_jobs(jobs, rows.drop("title"), wiki(spark, folder), snapshots(spark, folder))
    return found.select("web_capture_id", F.col("page_title").alias("title"), "snapshot_id", "etag")


@query("snapshot_lookups", f"WITH {WIKI}, {CAPTURES}, {SNAPSHOTS} SELECT id, 'list' AS kind FROM snapshots WHERE web_capture_id = 7 UNION ALL SELECT s.id * 10, 'asset' FROM snapshots s JOIN captures c ON c.id = s.web_capture_id JOIN wiki w ON w.id = c.page_id AND w.deleted_at IS NULL WHERE s.blob_sha256 = (SELECT sha256(url) FROM pages WHERE page_id = 8)")
def snapshot_lookups(spark, folder):
    rows = snapshots(spark, folder)
    wanted = read_table(spark, folder, "pages").filter("page_id = 8").select(text.sha256_hex(F.col("url")).alias("h")).first()["h"]
    assets = rows.select((F.col("id") * 10).alias("id"), F.col("id").alias("snapshot_id"), "blob_sha256")
    found = captures.asset_by_hash(assets, rows, capture_rows(spark, folder), wiki(spark, folder), wanted)
    return captures.snapshot_list(rows, 7).select("id", F.lit("list").alias("kind")).unionByName(found.select("id", F.lit("asset").alias("kind")))


@query(
    "refresh_now",
    f"""WITH {CAPTURES}, rows AS (SELECT c.*, 'failed after ' || length(html) || ' bytes' AS last_error, TIMESTAMP '2024-01-02' + to_seconds(length(html)) AS updated_at, length(html) % 3 > 0 AND status NOT IN ('queued', 'fetching') AS job,
      length(html) % 3 > 0 AND status IN ('queued', 'fetching') AS refused FROM captures c JOIN pages ON pages.page_id = c.id)
    SELECT id, CASE WHEN job THEN 'queued' ELSE status END AS status, CASE WHEN NOT job THEN last_error END AS last_error, {TIME.format("CASE WHEN NOT job THEN next_refresh_at END")} AS next_refresh_at,
      {TIME.format("CASE WHEN job THEN TIMESTAMP '2024-06-01' ELSE updated_at END")} AS updated_at, url, refresh_interval_seconds, document_id, etag, job, refused FROM rows""",
)
def refresh_now(spark, folder):
    """Captures of pages of certain lengths, all columns after the refresh."""
    size = F.length("html")
    more = read_table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("failed after "), size.cast("string"), F.lit(" bytes")).alias("last_error"), F.timestamp_add("SECOND", size, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).alias("updated_at"), (size % 3 > 0).alias("_wanted"))
    rows = capture_rows(spark, folder).join(more, "id")
    result = captures.refresh_now(rows.drop("_wanted"), rows.filter("_wanted"), "2024-06-01 00:00:00")
    jobs = result["jobs"].select(F.col("entity_id").alias("id"), F.lit(True).alias("job"))
    both = result["captures"].join(jobs, "id", "left").join(result["refused"].select("id", F.lit(True).alias("refused")), "id", "left")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return both.select("id", "status", "last_error", text_of_time("next_refresh_at").alias("next_refresh_at"), text_of_time("updated_at").alias("updated_at"), "url", "refresh_interval_seconds", "document_id", "etag", flag("job"), flag("refused"))


@query("create_captures", "SELECT min(page_id) AS no, url, count(*) - 1 AS refused FROM (SELECT page_id, regexp_replace(url, '[0-9]+', 'n', 'g') AS url FROM pages) WHERE url NOT IN (SELECT regexp_replace(url, '[0-9]+', 'n', 'g') FROM pages WHERE page_id % 40 = 0) GROUP BY url")
def create_captures(spark, folder):
    """Addresses without their numbers, many of them alike; those of every fortieth page are captured already."""
    asked = read_spread(spark, folder, "pages", "page_id").select(F.col("page_id").alias("no"), F.regexp_replace("url", "[0-9]+", "n").alias("url"))
    known = asked.filter("no % 40 = 0").select("url").distinct()
    made = captures.create_captures(asked, known, "2024-06-01 00:00:00")
    again = made["refused"].join(asked, "no").groupBy("url").agg(F.count("*").alias("refused"))
    return made["inputs"].join(again, "url", "left").select("no", "url", F.coalesce("refused", F.lit(0)).alias("refused"))


@query(
    "create_research",
    "SELECT 500 + row_number() OVER (ORDER BY item_id) - 1 AS id, trim(text, ' ' || chr(10)) AS query, 'queued' AS status FROM benchmark WHERE length(text) % 5 BETWEEN 1 AND 4",
)
def create_research(spark, folder):
    """Benchmark texts as research questions; a fifth asks for no sources or has only blanks."""
    rows = read_table(spark, folder, "benchmark")
    asked = rows.select(F.col("item_id").alias("no"), F.when((F.length("text") % 5 == 0) & (F.col("item_id") % 2 == 0), F.lit("  ")).otherwise(F.concat(F.lit(" "), "text")).alias("query"), F.when((F.length("text") % 5 == 0) & (F.col("item_id") % 2 == 1), 0).otherwise(9).alias("max_sources"))
    return captures.create_research(asked, 500, "2024-06-01 00:00:00")[0].select("id", "query", "status")


@query(
    "operational_statistics",
    f"""WITH {WIKI}, {CAPTURES}, {fold_sql(1800, JOB_BACKOFF)} SELECT * FROM (SELECT 'active_pages' AS name, count(*) AS value FROM wiki WHERE deleted_at IS NULL UNION ALL SELECT 'deleted_pages', count(*) FROM wiki WHERE deleted_at IS NOT NULL
    UNION ALL SELECT 'revisions', count(*) FROM events UNION ALL SELECT 'attachments', count(*) FROM documents UNION ALL SELECT 'documents', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'web_captures', count(*) FROM captures
    UNION ALL SELECT 'web_assets', sum(1 + length(html) % 2)::BIGINT FROM pages UNION ALL SELECT 'research_jobs', count(*) FROM benchmark
    UNION ALL SELECT 'pending_document_jobs', count(*) FROM queue UNION ALL SELECT 'pending_web_capture_jobs', count(*) FROM captures WHERE status IN ('queued', 'fetching') UNION ALL SELECT 'pending_research_jobs', count(*) FROM benchmark WHERE item_id % 2 = 0
    UNION ALL SELECT 'pending_semantic_jobs', count(*) FROM queue UNION ALL SELECT 'blob_count', count(DISTINCT sha256(text)) FROM documents UNION ALL SELECT 'blob_bytes', (SELECT sum(s) FROM (SELECT max(octet_length(encode(text))) AS s FROM documents GROUP BY sha256(text)))::BIGINT)""",
)
def operational_statistics(spark, folder):
    """All fourteen figures of the archive's state."""
    pages, queue = wiki(spark, folder), queues.fold(queue_events(spark, folder), queues.LEASE_SECONDS["documents"], queues.JOB_POLICY)
    rows, research = capture_rows(spark, folder), read_table(spark, folder, "benchmark")
    texts = read_spread(spark, folder, "documents", "doc_id")
    counted = {
        "active_pages": filters.active(pages), "deleted_pages": filters.deleted(pages), "revisions": read_table(spark, folder, "events"), "attachments": texts, "documents": archive_documents(spark, folder), "web_captures": rows,
        "web_assets": snapshots(spark, folder), "research_jobs": research, "pending_document_jobs": queue, "pending_web_capture_jobs": rows.filter(F.col("status").isin("queued", "fetching")),
        "pending_research_jobs": research.filter("item_id % 2 = 0"), "pending_semantic_jobs": queue,
    }
    stored = blobs.addressed(texts.select("text"), "text").groupBy("sha256").agg(F.max("size").alias("size"))
    return blobs.statistics(counted, stored)


@query(
    "queue_counts",
    f"""WITH {fold_sql(1800, JOB_BACKOFF)} SELECT 'documents' AS name, CASE WHEN lease_until >= TIMESTAMP '{NOW}' THEN 'working' WHEN available_at > TIMESTAMP '{NOW}' THEN 'later' ELSE 'waiting' END AS state, count(*) AS value FROM queue GROUP BY ALL""",
)
def queue_counts(spark, folder):
    return blobs.queue_counts({"documents": queues.fold(queue_events(spark, folder), queues.LEASE_SECONDS["documents"], queues.JOB_POLICY)}, NOW)


@query(
    "queue_delayed",
    """WITH e AS (SELECT user_id AS entity_id, event_type, ts, event_id, {'t': ts, 'n': event_id} AS place FROM events), r AS (SELECT entity_id, max(place) AS m FROM e WHERE event_type = 'signup' GROUP BY entity_id),
    d AS (SELECT e.entity_id, max(place) AS last FROM e JOIN r ON r.entity_id = e.entity_id WHERE event_type = 'view' AND place > m GROUP BY e.entity_id)
    SELECT r.entity_id, strftime(greatest(r.m.t, d.last.t + to_seconds(d.last.n % 100)), '%Y-%m-%d %H:%M:%S') AS available_at FROM r LEFT JOIN d ON d.entity_id = r.entity_id""",
)
def queue_delayed(spark, folder):
    """Views put a job off by as many seconds as the last two digits of their number."""
    events = read_table(spark, folder, "events").filter(F.col("event_type").isin("signup", "view"))
    log = events.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("at"), "event_id", F.when(F.col("event_type") == "signup", "requested").otherwise("delayed").alias("kind"), (F.col("event_id") % 100).alias("delay_seconds"))
    return queues.fold(log, 60, queues.VECTOR_POLICY).select("entity_id", text_of_time("available_at").alias("available_at"))


@query("config_reindex", f"WITH {WIKI} SELECT id AS entity_id, 'requested' AS kind FROM wiki WHERE deleted_at IS NULL")
def config_reindex(spark, folder):
    """A changed chunk size asks for every live page; the same one for none."""
    live = filters.active(wiki(spark, folder))
    unchanged = queues.requeue_for_config({"chunk": 1600}, {"chunk": 1600}, live, "2024-06-01 00:00:00")
    changed = queues.requeue_for_config({"chunk": 1600}, {"chunk": 1200}, live, "2024-06-01 00:00:00")
    assert unchanged is None
    return changed.select("entity_id", "kind")


@query("tagging_requeue", f"WITH {WIKI} SELECT DISTINCT conv_id AS document_id, 2 AS version FROM conversations WHERE conv_id % 7 <> 0 AND conv_id IN (SELECT id FROM wiki WHERE deleted_at IS NULL)")
def tagging_requeue(spark, folder):
    return documents.tagging_targets(archive_documents(spark, folder), document_versions(spark, folder), wiki(spark, folder)).select("document_id", "version")


@query(
    "create_documents",
    f"""WITH {WIKI} SELECT d.doc_id AS page_id, sha256(d.text) AS sha256, d.source || '.md' AS filename, 'markdown' AS format, 'queued' AS status, w.title AS managed_title FROM documents d JOIN wiki w ON w.id = d.doc_id""",
)
def create_documents(spark, folder):
    files = read_spread(spark, folder, "documents", "doc_id").select(F.col("doc_id").alias("page_id"), F.concat("source", F.lit(".md")).alias("filename"), F.lit("text/markdown").alias("mime"), F.encode("text", "UTF-8").alias("content"))
    made = documents.new_documents(files, wiki(spark, folder), "2024-06-01 00:00:00")
    versions = made["versions"].select(F.col("document_id").alias("id"), "sha256")
    return made["documents"].join(versions, "id").select("page_id", "sha256", "filename", "format", "status", "managed_title")


@query(
    "replace_documents",
    f"""WITH {WIKI}, v AS (SELECT conv_id AS document_id, turn + 1 AS version, CASE WHEN length(text) % 2 = 0 THEN 'queued' ELSE 'ready' END AS status, max(turn + 1) OVER (PARTITION BY conv_id) AS latest, sum(length(text)) OVER (PARTITION BY conv_id) % 3 = 0 AS replaced FROM conversations)
    SELECT document_id, version, CASE WHEN replaced AND status = 'queued' THEN 'superseded' ELSE status END AS status FROM v UNION ALL SELECT DISTINCT document_id, latest + 1, 'queued' FROM v WHERE replaced""",
)
def replace_documents(spark, folder):
    """A third of the conversations gets a new file: the next version is queued, unfinished ones are superseded."""
    turns = read_spread(spark, folder, "conversations", "conv_id")
    versions = turns.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("version"), F.md5("text").alias("sha256"), F.when(F.length("text") % 2 == 0, "queued").otherwise("ready").alias("status"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    chosen = turns.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).filter("n % 3 = 0")
    files = chosen.select(F.col("conv_id").alias("document_id"), F.lit("new.md").alias("filename"), F.lit("text/markdown").alias("mime"), F.encode(F.col("n").cast("string"), "UTF-8").alias("content"))
    pages = wiki(spark, folder)
    managed = pages.select(F.col("id").alias("page_id"), F.col("title").alias("managed_title"), F.col("body").alias("managed_body"), F.col("tags").alias("managed_tags"), F.col("properties").alias("managed_properties"))
    stored = archive_documents(spark, folder).join(managed, "page_id").select("*", F.lit("text/plain").alias("mime_type"), F.lit(False).alias("needs_ocr"), F.lit(False).alias("needs_review"))
    return documents.replace_documents(stored, versions, pages, files, "2024-06-01 00:00:00")["versions"].select("document_id", F.col("version").cast("bigint").alias("version"), "status")


@query("upserted_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 5 = 0")
def upserted_rows(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changes = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit(0).cast(orders.schema["o_totalprice"].dataType).alias("o_totalprice"))
    return upsert(orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice"), changes, ["o_orderkey"])


@query("normalized_properties", "SELECT doc_id, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT doc_id, unnest(['lang.' || lang, 'source-' || source, 'z']) AS k FROM documents) GROUP BY doc_id")
def normalized_properties(spark, folder):
    rows = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "lang", "source")
    made = F.map_from_arrays(F.array(F.lit(" Z "), F.concat(F.lit("Source-"), "source"), F.concat(F.lit("LANG."), F.upper("lang"))), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    checked = rows.select("doc_id", filters.normalize_properties(made).alias("p"), filters.properties_error(made).alias("e")).filter("e is null")
    return checked.select("doc_id", F.array_join(F.map_keys("p"), ",").alias("keys"))


@query("property_refusals", "SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'property key is invalid' WHEN n_chars % 3 = 1 THEN 'duplicate property key' END AS error FROM documents")
def property_refusals(spark, folder):
    """Property maps with a bad key, with keys that meet after normalisation, and good ones."""
    rows = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "n_chars", "source")
    second = F.when(F.col("n_chars") % 3 == 0, F.lit("not a key")).when(F.col("n_chars") % 3 == 1, F.concat(F.upper("source"), F.lit(" "))).otherwise(F.lit("other"))
    made = F.map_from_arrays(F.array(F.col("source"), second), F.array(F.lit("1"), F.lit("2")))
    return rows.select("doc_id", filters.properties_error(made).alias("error"))


@query(
    "markdown_images",
    r"""SELECT page_id, 0 AS ordinal, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a/' || page_id || '.png' AS source_url, 'Fig ' || page_id AS alt FROM pages
    UNION ALL SELECT page_id, 1, 'http://8.8.8.8/' || page_id, 'x y' FROM pages""",
)
def markdown_images(spark, folder):
    """Three images for each page, one of them at a private address."""
    pages = read_spread(spark, folder, "pages", "page_id").select("page_id", "url")
    ident = F.col("page_id").cast("string")
    markdown = F.concat(F.lit("text ![Fig "), ident, F.lit("](/b/../a/"), ident, F.lit('.png "t") and ![no](http://10.0.0.1/x) ![x[\\ y](http://0x8.8.8.8/'), ident, F.lit(")"))
    return pages.select("page_id", F.inline(html.markdown_images(markdown, F.regexp_extract("url", "^(https?://[^/?#]+)", 1)))).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("capture_export", "SELECT page_id AS web_capture_id, '![i](resources/' || substr(sha256(url), 1, 12) || '-p ' || page_id || '.png) ' || url AS content FROM pages")
def capture_export(spark, folder):
    """Articles whose stored picture becomes a local resource."""
    pages = read_spread(spark, folder, "pages", "page_id").select(F.col("page_id").alias("web_capture_id"), "url", text.sha256_hex(F.col("url")).alias("blob_sha256"))
    name = F.concat(F.lit("p "), F.col("web_capture_id").cast("string"), F.lit(".png"))
    assets = pages.select("web_capture_id", "blob_sha256", name.alias("filename"))
    stored = F.concat(F.lit("![i](/web-assets/"), "blob_sha256", F.lit("/p%20"), F.col("web_capture_id").cast("string"), F.lit(".png) "), "url")
    return frontmatter.capture_article(pages.select("web_capture_id", stored.alias("content")), assets)


@query("search_requests", "SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'refused' WHEN n_chars % 4 = 1 THEN 'pages and sections' WHEN n_chars % 4 = 2 THEN 'sections' ELSE 'pages' END AS parts FROM documents")
def search_requests(spark, folder):
    """Which kinds of hits a request can have: with words, with a facet of documents only, for pages only, and without anything."""
    def parts(query_text: str, source: str, **facets) -> str:
        try:
            with_pages, with_sections = filters.check_search_request(query_text, [], {}, SectionFilters(source=source, **facets))
        except RequestError:
            return "refused"
        return " and ".join(name for name, wanted in (("pages", with_pages), ("sections", with_sections)) if wanted)

    kinds = [parts(" ", "all"), parts("word", "all"), parts("word", "all", format="pdf"), parts("word", "pages")]
    rows = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "n_chars")
    return rows.select("doc_id", F.get(F.array(*[F.lit(kind) for kind in kinds]), (F.col("n_chars") % 4).cast("int")).alias("parts"))


@query(
    "hybrid_fallback",
    f"WITH {two_rankings('the')}, lists AS (SELECT * FROM plist UNION ALL SELECT * FROM llist), {RRF} SELECT hit, 'lexical' AS mode, 'Semantic index is unavailable or empty; lexical results are shown.' AS warning FROM shown",
)
def hybrid_fallback(spark, folder):
    """A vector without an index to ask: the lexical hits, and a warning."""
    hits, mode, warning = hybrid.search(wiki(spark, folder), searchable(spark, folder), "the", vector=[1.0])
    return hits.select("hit", F.lit(mode).alias("mode"), F.lit(warning).alias("warning"))


@query("cursor_pages", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 25")
def cursor_pages(spark, folder):
    """The third page of a ranked list by its bound cursor: ten rows after twenty-five."""
    orders = read_table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey")
    mark = cursors.fingerprint(mode="lexical", query="price")
    offset = cursors.decode_hybrid(cursors.encode_hybrid(25, mark), mark)
    return orders.offset(offset).limit(cursors.strict_limit(10))


QUESTION = "Wie viel zzqq tion ment?"
VOTES = ", ".join(
    f"""k{number} AS (SELECT hit, page_id, {number} AS keyword_no, row_number() OVER (ORDER BY round(score, 12) DESC, hit) AS rank FROM (
      WITH {two_rankings(word)}, lists AS (SELECT * FROM plist UNION ALL SELECT * FROM llist), {RRF} SELECT hit, page_id, score FROM shown))"""
    for number, word in enumerate(("wie", "viel", "zzqq", "tion", "ment"))
)
VOTES += """, found AS (SELECT * FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4) WHERE rank <= 4),
    votes AS (SELECT hit, page_id, row_number() OVER (ORDER BY count(*) DESC, min(rank), min(keyword_no * 1000 + rank)) AS rank FROM found GROUP BY hit, page_id)"""


def asked(spark, folder):
    return answering.retrieve(wiki(spark, folder), searchable(spark, folder), QUESTION)


@query("question_hits", f"WITH {VOTES} SELECT hit, page_id, rank, 'keywords' AS mode FROM votes WHERE rank <= 4")
def question_hits(spark, folder):
    """A question whose words never stand together: its keywords vote over pages and sections."""
    hits, mode, _ = asked(spark, folder)
    return hits.select("hit", "page_id", F.col("rank").cast("bigint").alias("rank"), F.lit(mode).alias("mode"))


@query(
    "question_evidence",
    f"""WITH {VOTES}, {WIKI}, {SECTIONS}, texts AS (SELECT 'p:' || id AS hit, 'page' AS source, title, alias AS locator, '/wiki/' || alias AS url, body AS content FROM wiki WHERE deleted_at IS NULL
      UNION ALL SELECT 'd:' || section_id, 'document', filename, label, '/documents/' || document_id || '/content?offset=' || (ordinal // 50) * 50 || '#section-' || ordinal, text FROM searchable)
    SELECT 'E' || v.rank AS evidence_id, t.source, t.title, t.locator, t.url, substr(t.content, 1, 3500) AS content FROM votes v JOIN texts t USING (hit) WHERE v.rank <= 4""",
)
def question_evidence(spark, folder):
    """The same hits as numbered evidence with locators and addresses."""
    hits, _, _ = asked(spark, folder)
    rows = answering.evidence(hits, wiki(spark, folder), searchable(spark, folder))
    return rows.select("evidence_id", "source", "title", "locator", "url", "content")
