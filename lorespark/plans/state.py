"""Queues, revisions, blobs, archives, captures, and batches of page changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import slugify
from ..operators import blobs, captures, filters, history, lifecycle, queues
from ..session import cut_lineage, own_folder
from ..sources.tables import read_spread, read_table
from ..streaming import jobs
from .fixtures import TIME, WIKI, queue_events, text_of_time, wiki

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def fold_sql(lease: int, backoff: str) -> str:
    return f"""log AS (SELECT user_id AS e, ts, event_id, CASE event_type WHEN 'signup' THEN 'requested' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'renewed' WHEN 'error' THEN 'failed' ELSE 'completed' END AS kind FROM events),
    req AS (SELECT e, max(ts) AS rts, max(event_id) AS rid, count(*) AS revision FROM log WHERE kind = 'requested' GROUP BY e),
    later AS (SELECT l.* FROM log l JOIN req USING (e) WHERE kind <> 'requested' AND (ts, event_id) > (rts, rid)),
    facts AS (SELECT e, max(ts) FILTER (WHERE kind = 'claimed') AS c, arg_max(event_id, ts) FILTER (WHERE kind = 'claimed') AS cid, max(ts) FILTER (WHERE kind = 'renewed') AS n, max(ts) FILTER (WHERE kind = 'failed') AS f,
      count(*) FILTER (WHERE kind = 'failed') AS attempts, bool_or(kind = 'completed') AS done FROM later GROUP BY e),
    queue AS (SELECT req.e AS entity_id, rts AS requested_at, revision, coalesce(attempts, 0) AS attempts,
      greatest(rts, f + to_seconds({backoff})) AS available_at,
      CASE WHEN c IS NOT NULL AND (f IS NULL OR c > f) THEN 'worker-' || cid % 7 END AS lease_owner,
      CASE WHEN c IS NOT NULL AND (f IS NULL OR c > f) THEN CASE WHEN n > c THEN n ELSE c END + to_seconds({lease}) END AS lease_until
      FROM req LEFT JOIN facts ON facts.e = req.e WHERE NOT coalesce(done, false))"""


JOB_BACKOFF = "least(60, power(2, least(attempts, 30))::BIGINT)"
VECTOR_BACKOFF = "least(300, power(2, least(attempts, 8))::BIGINT)"
SHOWN = f"entity_id, {TIME.format('requested_at')} AS requested_at, {TIME.format('available_at')} AS available_at, attempts, revision, lease_owner, {TIME.format('lease_until')} AS lease_until"


def shown(queue):
    return queue.select(
        "entity_id", text_of_time("requested_at").alias("requested_at"), text_of_time("available_at").alias("available_at"), "attempts", "revision", "lease_owner", text_of_time("lease_until").alias("lease_until")
    )


def job_queue(spark, folder):
    return queues.fold(queue_events(spark, folder), queues.LEASE_SECONDS["documents"], queues.JOB_POLICY)


@query("queue_fold", f"WITH {fold_sql(1800, JOB_BACKOFF)} SELECT {SHOWN} FROM queue")
def queue_fold(spark, folder):
    return shown(job_queue(spark, folder))


@query("queue_fold_vectors", f"WITH {fold_sql(60, VECTOR_BACKOFF)} SELECT {SHOWN} FROM queue")
def queue_fold_vectors(spark, folder):
    return shown(queues.fold(queue_events(spark, folder), queues.LEASE_SECONDS["page_vectors"], queues.VECTOR_POLICY))


NOW = "2024-01-30 23:00:00"


@query(
    "queue_claimable",
    f"WITH {fold_sql(1800, JOB_BACKOFF)} SELECT entity_id, attempts FROM queue WHERE available_at <= TIMESTAMP '{NOW}' AND (lease_until IS NULL OR lease_until < TIMESTAMP '{NOW}') AND attempts < 3",
)
def queue_claimable(spark, folder):
    return queues.claimable(job_queue(spark, folder), NOW, queues.JOB_POLICY).select("entity_id", "attempts")


@query(
    "queue_claim",
    f"WITH {fold_sql(1800, JOB_BACKOFF)} SELECT entity_id, 'claimed' AS kind, 'w1' AS owner, revision FROM queue WHERE available_at <= TIMESTAMP '{NOW}' AND (lease_until IS NULL OR lease_until < TIMESTAMP '{NOW}') AND attempts < 3 ORDER BY requested_at, entity_id LIMIT 16",
)
def queue_claim(spark, folder):
    return queues.claim(job_queue(spark, folder), NOW, "w1", queues.JOB_POLICY, 16).select("entity_id", "kind", "owner", "revision")


@query(
    "queue_backoff",
    f"""WITH {fold_sql(1800, JOB_BACKOFF)} SELECT entity_id, attempts + 1 AS attempts, {TIME.format(f"TIMESTAMP '{NOW}' + to_seconds(least(60, power(2, least(attempts + 1, 30))::BIGINT))")} AS available_at, CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'queued' END AS status FROM queue""",
)
def queue_backoff(spark, folder):
    after = queues.failure_states(job_queue(spark, folder), queues.JOB_POLICY, NOW)
    return after.select("entity_id", "attempts", text_of_time("available_at").alias("available_at"), "status")


@query(
    "queue_complete_guard",
    f"WITH {fold_sql(1800, JOB_BACKOFF)} SELECT entity_id, revision FROM queue WHERE lease_owner IS NOT NULL AND entity_id % 2 = 0 AND entity_id % 3 <> 0",
)
def queue_complete_guard(spark, folder):
    """A result per job: for an old revision on odd entities, from another worker on every third."""
    queue = job_queue(spark, folder)
    ident = F.col("entity_id")
    results = queue.select(
        "entity_id", F.when(ident % 2 == 0, F.col("revision")).otherwise(F.col("revision") - 1).alias("revision"),
        F.when(ident % 3 == 0, F.lit("another")).otherwise(F.coalesce("lease_owner", F.lit("nobody"))).alias("owner"),
    )
    return queues.accepted(results, queue).select("entity_id", "revision")


@query(
    "queue_transitions",
    """SELECT o_orderkey AS id, s AS status, s IN ('queued', 'extracting') AS can_cancel, s IN ('failed', 'cancelled') OR (s = 'ready' AND o_orderkey % 2 = 0) AS can_retry FROM (
      SELECT o_orderkey, ['queued', 'extracting', 'ready', 'failed', 'cancelled'][o_orderkey % 5 + 1] AS s FROM orders)""",
)
def queue_transitions(spark, folder):
    states = F.array(*[F.lit(state) for state in ("queued", "extracting", "ready", "failed", "cancelled")])
    key = F.col("o_orderkey")
    documents = read_table(spark, folder, "orders").select(key.alias("id"), F.element_at(states, (key % 5 + 1).cast("int")).alias("status"), (key % 2 == 0).alias("needs_ocr"))
    both = queues.transition(documents, "documents", "cancel", extra=["needs_ocr"]).withColumnRenamed("allowed", "can_cancel").drop("new_status")
    return queues.transition(both, "documents", "retry", extra=["can_cancel"]).select("id", "status", "can_cancel", F.col("allowed").alias("can_retry"))


def capture_rows(spark, folder):
    """Pages as captures with a refresh plan."""
    pages = read_spread(spark, folder, "pages", "page_id")
    ident = F.col("page_id")
    states = F.array(*[F.lit(state) for state in ("ready", "queued", "fetching", "failed")])
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return pages.select(
        ident.alias("id"), "page_id", "url", F.element_at(states, (ident % 4 + 1).cast("int")).alias("status"),
        F.when(ident % 3 != 0, (ident + 5) * 60).alias("refresh_interval_seconds"),
        F.when(ident % 3 != 0, F.timestamp_add("MINUTE", ident * 10, start)).alias("next_refresh_at"),
        F.when(ident % 5 != 0, ident * 2).alias("document_id"), F.concat(F.lit("Capture "), ident.cast("string")).alias("title"), F.concat(F.lit('"tag-'), ident.cast("string"), F.lit('"')).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
    )


CAPTURES = """captures AS (SELECT page_id AS id, page_id, url, ['ready', 'queued', 'fetching', 'failed'][page_id % 4 + 1] AS status, CASE WHEN page_id % 3 <> 0 THEN (page_id + 5) * 60 END AS refresh_interval_seconds,
    CASE WHEN page_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(page_id * 10) END AS next_refresh_at, CASE WHEN page_id % 5 <> 0 THEN page_id * 2 END AS document_id, '"tag-' || page_id || '"' AS etag FROM pages)"""


@query(
    "due_refreshes",
    f"WITH {CAPTURES}, {WIKI} SELECT id, {TIME.format('next_refresh_at')} AS next_refresh_at FROM captures WHERE next_refresh_at <= TIMESTAMP '2024-01-01 20:00:00' AND status NOT IN ('queued', 'fetching') AND page_id IN (SELECT id FROM wiki WHERE deleted_at IS NULL)",
)
def due_refreshes(spark, folder):
    due = queues.due_refreshes(capture_rows(spark, folder), filters.active(wiki(spark, folder)), "2024-01-01 20:00:00")
    return due.select("id", text_of_time("next_refresh_at").alias("next_refresh_at"))


@query(
    "visible_captures",
    f"WITH {CAPTURES} SELECT id, CASE WHEN id % 7 = 0 THEN 'transcribing' ELSE status END AS status, NOT (id % 7 = 0 OR status IN ('queued', 'fetching')) AS can_refresh FROM captures",
)
def visible_captures(spark, folder):
    rows = capture_rows(spark, folder)
    running = rows.filter(F.col("id") % 7 == 0).select(F.col("id").alias("web_capture_id"))
    return captures.visible(rows, running).select("id", "status", captures.can_refresh(F.col("status")).alias("can_refresh"))


def snapshot_rows(spark, folder):
    """Two snapshots per captured page; the newer one holds the present bytes, except for a third of them."""
    pages = read_spread(spark, folder, "pages", "page_id").select("page_id", "html")
    ident = F.col("page_id")
    number = F.explode(F.array(F.lit(0), F.lit(1))).alias("number")
    # A tenth of the snapshots belongs to captures that are not there, so as many captures have none.
    both = pages.withColumn("page_id", F.when(ident % 10 == 9, ident + 1_000_000).otherwise(ident)).select("page_id", "html", number)
    content = F.when((F.col("number") == 1) & (ident % 3 != 0), F.col("html")).otherwise(F.concat("html", F.lit("<!-- old -->")))
    return both.select((ident * 2 + F.col("number")).alias("id"), ident.alias("web_capture_id"), F.sha2(content, 256).alias("blob_sha256"), (ident % 4 != 0).alias("assets_captured"))


def asset_rows(frame, key, changed):
    """Two images per snapshot or result; a changed one has another label."""
    label = F.when(changed, F.lit("new")).otherwise(F.lit("old"))
    item = lambda number: F.struct(F.lit(number).alias("ordinal"), F.sha2(F.lit(f"image{number}"), 256).alias("blob_sha256"), F.lit(f"https://example.com/{number}.png").alias("source_url"), label.alias("alt_text"))
    return frame.select(key, F.inline(F.array(item(0), item(1))))


@query(
    "snapshot_changes",
    """SELECT page_id AS web_capture_id, CASE WHEN page_id % 8 = 1 THEN 'not_modified' WHEN page_id % 10 <> 9 AND page_id % 4 <> 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 'unchanged' ELSE 'changed' END AS outcome FROM pages""",
)
def snapshot_changes(spark, folder):
    pages = read_spread(spark, folder, "pages", "page_id").select("page_id", "html")
    ident = F.col("page_id")
    results = pages.select(ident.alias("web_capture_id"), F.sha2("html", 256).alias("blob_sha256"), F.when(ident % 8 == 1, F.lit("not_modified")).otherwise(F.lit("content")).alias("kind"))
    snapshots = snapshot_rows(spark, folder)
    stored = asset_rows(snapshots.withColumnRenamed("id", "snapshot_id"), "snapshot_id", F.lit(False))
    fetched = asset_rows(results, "web_capture_id", F.col("web_capture_id") % 5 == 0)
    return captures.detect_changes(results, snapshots, stored, fetched).select("web_capture_id", "outcome")


@query("latest_assets", "SELECT p AS web_capture_id, o AS ordinal, p * 2 + 1 AS snapshot_id FROM (SELECT CASE WHEN page_id % 10 = 9 THEN page_id + 1000000 ELSE page_id END AS p FROM pages), (VALUES (0), (1)) AS v(o)")
def latest_assets(spark, folder):
    snapshots = snapshot_rows(spark, folder)
    stored = asset_rows(snapshots.withColumnRenamed("id", "snapshot_id"), "snapshot_id", F.lit(False))
    return captures.latest_assets(snapshots, stored).select("web_capture_id", "ordinal", "snapshot_id")


@query("fetch_conditions", f"WITH {CAPTURES} SELECT id, CASE WHEN id % 10 <> 9 AND id % 4 <> 0 THEN etag END AS etag FROM captures")
def fetch_conditions(spark, folder):
    return captures.fetch_conditions(capture_rows(spark, folder), snapshot_rows(spark, folder)).select("id", "etag")


def research_rows(spark, folder):
    """A research job per ten captures, over those of its own ten and one address nobody captured."""
    rows = capture_rows(spark, folder)
    job = F.floor(F.col("id") / 10).alias("research_id")
    known = rows.select(job, "url")
    return rows, known.unionByName(known.select("research_id").distinct().withColumn("url", F.concat(F.lit("https://new.example.org/"), F.col("research_id").cast("string"))))


@query(
    "research_source_plan",
    f"""WITH {CAPTURES} SELECT id // 10 AS research_id, url, CASE WHEN status = 'failed' THEN 'retry' ELSE 'reuse' END AS action FROM captures
    UNION ALL SELECT DISTINCT id // 10, 'https://new.example.org/' || (id // 10), 'create' FROM captures""",
)
def research_source_plan(spark, folder):
    rows, wanted = research_rows(spark, folder)
    return captures.plan_sources(wanted, rows).select("research_id", "url", "action")


@query(
    "research_readiness",
    f"""WITH {CAPTURES}, s AS (SELECT id // 10 AS research_id, CASE WHEN id % 2 = 1 AND status = 'queued' THEN 'failed' WHEN status = 'fetching' AND id % 20 < 10 THEN 'failed' ELSE status END AS status, document_id FROM captures),
    d AS (SELECT *, CASE WHEN document_id % 12 = 0 THEN 'extracting' WHEN document_id IS NOT NULL THEN 'ready' END AS ds FROM s)
    SELECT research_id, count(*) FILTER (WHERE status IN ('queued', 'fetching') OR (status = 'ready' AND ds = 'extracting')) AS pending,
      coalesce(string_agg(document_id::VARCHAR, ',' ORDER BY document_id) FILTER (WHERE status = 'ready' AND ds = 'ready'), '') AS usable,
      CASE WHEN count(*) FILTER (WHERE status IN ('queued', 'fetching') OR (status = 'ready' AND ds = 'extracting')) > 0 THEN 'wait' WHEN count(*) FILTER (WHERE status = 'ready' AND ds = 'ready') = 0 THEN 'fail' ELSE 'answer' END AS next_step
    FROM d GROUP BY research_id""",
)
def research_readiness(spark, folder):
    rows = capture_rows(spark, folder)
    status = F.when((F.col("id") % 2 == 1) & (F.col("status") == "queued"), F.lit("failed")).when((F.col("status") == "fetching") & (F.col("id") % 20 < 10), F.lit("failed")).otherwise(F.col("status"))
    rows = rows.withColumn("status", status)
    sources = rows.select(F.floor(F.col("id") / 10).alias("research_id"), F.col("id").alias("web_capture_id"), "url")
    documents = rows.filter(F.col("document_id").isNotNull()).select(F.col("document_id").alias("id"), F.when(F.col("document_id") % 12 == 0, F.lit("extracting")).otherwise(F.lit("ready")).alias("status"))
    ready = captures.research_readiness(sources, rows, documents)
    return ready.select("research_id", "pending", F.array_join("usable", ",").alias("usable"), "next_step")


@query(
    "revision_changes",
    """SELECT user_id AS page_id, event_id, event_type AS status, prev AS previous_status FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS prev, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE n > 1 AND event_type IS DISTINCT FROM prev""",
)
def revision_changes(spark, folder):
    events = read_table(spark, folder, "events").select(F.col("user_id").alias("page_id"), "ts", "event_id", F.col("event_type").alias("status"))
    changed = history.changes_in_stream(events, "page_id", ["ts", "event_id"], ["status"], F.to_date("ts"))
    return changed.select("page_id", "event_id", "status", F.col("prev_status").alias("previous_status"))


def page_updates(pages):
    """Even pages get a new status, every third a new title, every fifth only what it has already."""
    ident = F.col("id")
    return pages.filter(F.col("deleted_at").isNull()).select(
        "id",
        F.when(ident % 5 == 0, F.col("title")).when(ident % 3 == 0, F.concat(F.lit("New "), "title")).alias("title"),
        F.when((ident % 5 != 0) & (ident % 2 == 0), F.lit("archived")).alias("status"),
    )


CHANGED = "deleted_at IS NULL AND id % 5 <> 0 AND (id % 3 = 0 OR id % 2 = 0)"


@query("update_revisions", f"WITH {WIKI} SELECT id AS page_id, title, status, 'rest' AS source FROM wiki WHERE {CHANGED}")
def update_revisions(spark, folder):
    pages = wiki(spark, folder)
    _, revisions, _ = lifecycle.update_pages(pages, page_updates(pages), "rest", "2024-07-01 00:00:00")
    return revisions.select("page_id", "title", "status", "source")


@query(
    "update_pages",
    f"""WITH {WIKI} SELECT id, CASE WHEN deleted_at IS NULL AND id % 5 <> 0 AND id % 3 = 0 THEN 'New ' || title ELSE title END AS title, CASE WHEN deleted_at IS NULL AND id % 5 <> 0 AND id % 2 = 0 THEN 'archived' ELSE status END AS status,
      CASE WHEN {CHANGED} THEN '2024-07-01 00:00:00' ELSE {TIME.format('updated_at')} END AS updated_at FROM wiki""",
)
def update_pages(spark, folder):
    pages = wiki(spark, folder)
    after, _, _ = lifecycle.update_pages(pages, page_updates(pages), "rest", "2024-07-01 00:00:00")
    return after.select("id", "title", "status", text_of_time("updated_at").alias("updated_at"))


def doubtful_updates(pages):
    """Updates with all kinds of faults: aliases of others, swapped and shared aliases, bad forms, missing parents, circles."""
    ident, kind = F.col("id"), F.col("id") % 12
    text = lambda column: F.concat(F.lit("doc-"), column.cast("string"))
    return pages.filter(F.col("deleted_at").isNull()).select(
        "id",
        F.when(kind == 1, text(ident + 1)).when(kind == 2, text(ident + 20_000_000)).when(kind == 3, F.concat(F.lit("Lang-"), F.substring("title", 1, 0), F.expr("properties['lang']").substr(2, 2)))
        .when(kind == 4, F.lit("not an alias!")).when(kind == 5, F.concat(F.lit("  DOC-"), ident.cast("string"), F.lit(" "))).alias("alias"),
        F.when(kind == 6, F.lit(" ")).when(kind == 7, F.concat(F.lit(" New "), "title")).alias("title"),
        F.when(kind == 8, F.lit("gone")).alias("status"),
        kind.isin(9, 10, 11).alias("set_parent"),
        F.when(kind == 9, ident + 90_000_000).when(kind == 10, ident + 1).when(kind == 11, ident - 1).alias("parent_id"),
    )


DOUBTFUL = f"""WITH {WIKI}, live AS (SELECT *, id % 12 AS kind FROM wiki WHERE deleted_at IS NULL),
    plain AS (SELECT id, kind, lang, CASE WHEN kind = 4 THEN 'alias must contain lowercase ASCII letters, numbers, and single hyphens' WHEN kind = 6 THEN 'title must have 1 to 200 characters' WHEN kind = 8 THEN 'status is unknown'
        WHEN kind = 9 OR kind = 10 AND id + 1 NOT IN (SELECT id FROM live) OR kind = 11 AND id - 1 NOT IN (SELECT id FROM live) THEN 'parent page not found'
        WHEN kind = 10 AND id + 1 IN (SELECT id FROM live) OR kind = 11 AND id - 1 IN (SELECT id FROM live) THEN 'parent relationship would create a cycle'
        WHEN kind = 1 AND 'doc-' || (id + 1) IN (SELECT alias FROM wiki w WHERE w.id <> live.id) THEN 'alias already exists' 
        WHEN kind = 3 AND id > (SELECT min(id) FROM live l WHERE l.kind = 3 AND l.lang = live.lang) THEN 'alias already exists' END AS error FROM live)"""


@query("update_refusals", f"{DOUBTFUL} SELECT id, error FROM plain WHERE error IS NOT NULL")
def update_refusals(spark, folder):
    """Refused updates of a batch with their reasons; a page and the next one as each other's parents make a circle."""
    pages = wiki(spark, folder)
    return lifecycle.update_pages(pages, doubtful_updates(pages), "rest", "2024-07-01 00:00:00")[2]


@query(
    "restore_to_revision",
    f"""WITH {WIKI}, live AS (SELECT * FROM wiki WHERE deleted_at IS NULL),
    r AS (SELECT id, 'Old ' || title AS title, CASE WHEN id % 2 = 0 THEN 'doc-' || (id + 1) ELSE 'was-' || id END AS alias, id + 3 AS parent_id, CASE WHEN n_chars % 2 = 0 THEN 'archived' ELSE status END AS status, text_of FROM (SELECT *, 'Old ' || body AS text_of FROM live)),
    taken AS (SELECT r.*, EXISTS (SELECT 1 FROM live o WHERE o.alias = r.alias AND o.id <> r.id) AS suffix FROM r)
    SELECT t.id, t.title, CASE WHEN suffix THEN t.alias || '-2' ELSE t.alias END AS alias, t.status, p.id AS parent_id, sha256(text_of) AS body, 'rest' AS source FROM taken t LEFT JOIN live p ON p.id = t.parent_id AND p.id % 4 <> t.id % 4""",
)
def restore_to_revision(spark, folder):
    """Every live page brought back to an older state; where another page has the alias by now, it gets a number."""
    pages = wiki(spark, folder)
    ident = F.col("id")
    revisions = filters.active(pages).select(
        ident.alias("page_id"), F.concat(F.lit("Old "), "title").alias("title"), F.when(ident % 2 == 0, F.concat(F.lit("doc-"), (ident + 1).cast("string"))).otherwise(F.concat(F.lit("was-"), ident.cast("string"))).alias("alias"),
        F.concat(F.lit("Old "), "body").alias("body"), "tags", F.when(F.expr("cast(properties['chars'] as bigint)") % 2 == 0, F.lit("archived")).otherwise(F.col("status")).alias("status"), (ident + 3).alias("parent_id"), "properties",
    )
    after, written, refused = lifecycle.update_pages(pages, history.restore_updates(revisions, pages), "rest", "2024-07-01 00:00:00")
    sources = written.select(F.col("page_id").alias("id"), "source")
    shown = filters.active(after).select("id", "title", "alias", "status", "parent_id", text.sha256_hex(F.col("body")).alias("body"))
    return shown.join(sources, "id").select(*shown.columns, "source")


@query("revision_of_page", f"WITH {WIKI} SELECT event_id AS id, user_id AS page_id, event_type FROM events WHERE event_id IN (40, 41, 42, 43, 44, 45, 46, 47) AND user_id IN (SELECT id FROM wiki WHERE deleted_at IS NULL)")
def revision_of_page(spark, folder):
    """Eight revisions, each asked for under its own page and under another one."""
    pages = wiki(spark, folder)
    revisions = read_table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("page_id"), "event_type")
    asked = revisions.filter(F.col("id").between(40, 47)).orderBy("id").take(8)
    found = None
    for row in asked:
        both = history.revision_of(revisions, pages, row["page_id"], row["id"]).unionByName(history.revision_of(revisions, pages, row["page_id"] + 1, row["id"]))
        found = both if found is None else found.unionByName(both)
    return found.select("id", "page_id", "event_type")


@query("metadata_diff", f"WITH {WIKI} SELECT id AS revision_id, id AS page_id, id % 2 = 0 AND status <> 'archived' OR id % 3 = 0 AS metadata_changed FROM wiki")
def metadata_diff(spark, folder):
    """A revision per page: another status on even pages, reordered tags on every third, other properties nowhere."""
    pages = wiki(spark, folder)
    ident = F.col("id")
    revisions = pages.select(
        "id", F.col("id").alias("page_id"), "title", "alias", "body", F.when(ident % 3 == 0, F.reverse("tags")).otherwise(F.col("tags")).alias("tags"),
        F.when(ident % 2 == 0, F.lit("archived")).otherwise(F.col("status")).alias("status"), "parent_id", "properties",
    )
    return history.compare_revisions(revisions, pages).select("revision_id", "page_id", "metadata_changed")


@query(
    "restore_revisions",
    f"""WITH {WIKI}, r AS (SELECT id AS page_id, CASE WHEN id % 2 = 0 THEN 'doc-' || (id + 1) ELSE 'doc-' || id END AS alias, id + 3 AS parent_id FROM wiki WHERE deleted_at IS NULL)
    SELECT r.page_id, p.id AS parent_id, o.id IS NOT NULL AND o.id <> r.page_id AS alias_taken FROM r LEFT JOIN wiki p ON p.id = r.parent_id AND p.deleted_at IS NULL LEFT JOIN wiki o ON o.alias = r.alias AND o.deleted_at IS NULL""",
)
def restore_revisions(spark, folder):
    pages = wiki(spark, folder)
    ident = F.col("id")
    revisions = filters.active(pages).select(ident.alias("page_id"), F.concat(F.lit("doc-"), F.when(ident % 2 == 0, ident + 1).otherwise(ident).cast("string")).alias("alias"), (ident + 3).alias("parent_id"))
    return history.restore_revisions(revisions, pages).select("page_id", "parent_id", "alias_taken")


@query("human_edits", f"WITH {WIKI} SELECT id AS document_id, id % 3 = 0 OR id % 7 = 0 AS needs_review FROM wiki")
def human_edits(spark, folder):
    pages = wiki(spark, folder)
    documents = pages.select(
        "id", F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("?"))).otherwise(F.col("title")).alias("managed_title"), F.col("body").alias("managed_body"),
        F.col("tags").alias("managed_tags"), F.col("properties").alias("managed_properties"), (F.col("id") % 7 == 0).alias("needs_review"),
    )
    return history.human_edited(pages, documents).select("document_id", "needs_review")


@query(
    "line_diff",
    r"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '([.,]) ', '\1' || chr(10), 'g'), '[^\n]*\n|[^\n]+$') AS lines FROM conversations),
    p AS (SELECT a.conv_id, a.turn, b.lines AS b, a.lines AS a FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 2),
    dp AS (SELECT conv_id, turn, 0 AS i, list_transform(range(0, len(a) + 1), lambda j: 0) AS r FROM p
      UNION ALL SELECT d.conv_id, d.turn, d.i + 1, list_concat([0], list_transform(range(1, len(p.a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN p.a[k] = p.b[d.i + 1] THEN d.r[k] + 1 ELSE d.r[k + 1] END))))
      FROM dp d JOIN p ON d.conv_id = p.conv_id AND d.turn = p.turn WHERE d.i < len(p.b)),
    texts AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '([.,]) ', '\1' || chr(10), 'g'), '\n$', '') AS shown FROM conversations)
    SELECT p.conv_id, p.turn, CAST(dp.r[len(p.a) + 1] AS BIGINT) AS same_lines, sha256(b.shown) AS left_text, sha256(a.shown) AS right_text
    FROM p JOIN dp ON dp.conv_id = p.conv_id AND dp.turn = p.turn AND dp.i = len(p.b) JOIN texts a ON a.conv_id = p.conv_id AND a.turn = p.turn JOIN texts b ON b.conv_id = p.conv_id AND b.turn = p.turn - 2""",
)
def line_diff(spark, folder):
    """Each turn against the one two turns before, a line for each clause: equal lines, and both texts put together again."""
    turns = read_spread(spark, folder, "conversations", "conv_id").select("conv_id", "turn", F.regexp_replace("text", "([.,]) ", "$1\n").alias("text"))
    before = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("before"))
    rows = history.body_diff(turns.join(before, ["conv_id", "turn"]), "before", "text", ["conv_id", "turn"])
    side = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("line", name)))), lambda item: item[name]), "\n")
    grouped = rows.groupBy("conv_id", "turn").agg(F.count_if(F.col("left_kind") == "same").alias("same_lines"), side("left").alias("l"), side("right").alias("r"))
    return grouped.select("conv_id", "turn", "same_lines", text.sha256_hex(F.col("l")).alias("left_text"), text.sha256_hex(F.col("r")).alias("right_text"))


@query(
    "line_diff_totals",
    r"""WITH b AS (SELECT doc_id, rtrim(text, chr(10)) AS t FROM documents), l AS (SELECT doc_id, string_split(t, chr(10)) AS lines FROM b)
    SELECT doc_id, len(lines) AS same_lines, 1 AS added_lines, 0 AS removed_lines FROM l""",
)
def line_diff_totals(spark, folder):
    """Every document against itself with one line put in the middle."""
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", F.rtrim(F.col("text"), F.lit("\n")).alias("text"))
    lines = F.split("text", "\n")
    middle = F.floor(F.size(lines) / 2).cast("int")
    after = F.array_join(F.concat(F.slice(lines, F.lit(1), middle), F.array(F.lit("a line of its own")), F.slice(lines, middle + 1, F.size(lines))), "\n")
    rows = history.body_diff(documents.select("doc_id", "text", after.alias("after")), "text", "after", ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count_if(F.col("left_kind") == "same").alias("same_lines"), F.count_if(F.col("right_kind") == "added").alias("added_lines"), F.count_if(F.col("left_kind") == "removed").alias("removed_lines"))


def files(spark, folder):
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit("text/plain").alias("mime"))


@query("blob_dedup", "SELECT sha256(text) AS sha256, max(octet_length(encode(text))) AS size, count(*) AS copies FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') GROUP BY sha256(text)")
def blob_dedup(spark, folder):
    stored = blobs.addressed(read_spread(spark, folder, "documents", "doc_id").filter(F.col("source") == "src0"), "text").select("sha256")
    return blobs.new_blobs(files(spark, folder), stored).select("sha256", "size", "copies")


@query(
    "orphan_blobs",
    "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' UNION SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 UNION SELECT sha256(text) FROM benchmark UNION SELECT sha256(text) FROM conversations)",
)
def orphan_blobs(spark, folder):
    hashed = lambda frame: frame.select(F.sha2("text", 256).alias("sha256"))
    documents = read_spread(spark, folder, "documents", "doc_id")
    stored = hashed(documents).distinct()
    referrers = [documents.filter(F.col("lang") == "en"), documents.filter(F.col("doc_id") % 2 == 0), read_table(spark, folder, "benchmark"), read_spread(spark, folder, "conversations", "conv_id")]
    return blobs.orphan_blobs(stored, *[hashed(frame) for frame in referrers])


@query(
    "archive_verify",
    """SELECT 'files/' || doc_id AS path, CASE doc_id % 11 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' WHEN 2 THEN 'hash' WHEN 4 THEN 'hash' WHEN 3 THEN 'unexpected' END AS problem FROM documents WHERE doc_id % 11 IN (0, 1, 2, 3, 4)""",
)
def archive_verify(spark, folder):
    """A manifest of all documents against files of which some are gone, longer, altered, or unlisted."""
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")
    kind = F.col("doc_id") % 11
    path = F.concat(F.lit("files/"), F.col("doc_id").cast("string")).alias("path")
    listed = documents.filter(kind != 3).select(path, F.when(kind == 4, F.lit("no hash")).otherwise(F.sha2("text", 256)).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))
    altered = F.when(kind == 1, F.concat("text", F.lit("!"))).when(kind == 2, F.concat(F.lit("~"), F.expr("substring(encode(text, 'UTF-8'), 2)").cast("string"))).otherwise(F.col("text"))
    content = F.when(kind == 2, F.concat(F.unhex(F.lit("7E")), F.substring(F.encode("text", "UTF-8"), 2, 2_147_483_647))).otherwise(F.encode(altered, "UTF-8"))
    found = documents.filter(kind != 0).select(path, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("size"))
    return blobs.verify_archive(listed, found)


@query(
    "consistency_audit",
    """SELECT 'line of an order' AS "constraint", (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)) AS violations
    UNION ALL SELECT 'line of a part', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
    UNION ALL SELECT 'unique line', (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)
    UNION ALL SELECT 'unique order', 0 UNION ALL SELECT 'label with rating', (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL)""",
)
def consistency_audit(spark, folder):
    lines, orders = read_table(spark, folder, "lineitem"), read_table(spark, folder, "orders")
    labelled = read_spread(spark, folder, "documents", "doc_id").select("doc_id").join(read_table(spark, folder, "labels"), "doc_id", "left")
    return blobs.audit(
        blobs.foreign_key_violations(lines, "l_orderkey", orders.filter(F.col("o_orderkey") % 10 != 0), "o_orderkey", "line of an order"),
        blobs.foreign_key_violations(lines, "l_partkey", read_table(spark, folder, "part"), "p_partkey", "line of a part"),
        blobs.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], "unique line"),
        blobs.duplicate_keys(orders, ["o_orderkey"], "unique order"),
        blobs.null_violations(labelled, ["quality"], "label with rating"),
    )


@query(
    "ops_statistics",
    f"""WITH {WIKI} SELECT 'active_pages' AS name, count(*) AS value FROM wiki WHERE deleted_at IS NULL UNION ALL SELECT 'deleted_pages', count(*) FROM wiki WHERE deleted_at IS NOT NULL
    UNION ALL SELECT 'revisions', count(*) FROM events UNION ALL SELECT 'documents', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'sections', count(*) FROM conversations UNION ALL SELECT 'web_captures', count(*) FROM pages
    UNION ALL SELECT 'blob_count', count(DISTINCT sha256(text)) FROM documents UNION ALL SELECT 'blob_bytes', (SELECT sum(s) FROM (SELECT max(octet_length(encode(text))) AS s FROM documents GROUP BY sha256(text)))::BIGINT""",
)
def ops_statistics(spark, folder):
    pages = wiki(spark, folder)
    counted = {
        "active_pages": filters.active(pages), "deleted_pages": filters.deleted(pages), "revisions": read_table(spark, folder, "events"),
        "documents": read_spread(spark, folder, "conversations", "conv_id").select("conv_id").distinct(), "sections": read_spread(spark, folder, "conversations", "conv_id"), "web_captures": read_spread(spark, folder, "pages", "page_id"),
    }
    stored = blobs.addressed(read_spread(spark, folder, "documents", "doc_id").select("text"), "text").groupBy("sha256").agg(F.max("size").alias("size"))
    return blobs.statistics(counted, stored)


@query(
    "alias_assignment",
    """SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS alias FROM (SELECT doc_id AS id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) + (base = 'en-src0')::INT AS n FROM (SELECT doc_id, lang || '-' || source AS base FROM documents))""",
)
def alias_assignment(spark, folder):
    """Aliases from language and source of every document, so that most of them meet; one is taken before."""
    rows = read_spread(spark, folder, "documents", "doc_id")
    proposals = rows.select(F.col("doc_id").alias("id"), slugify(F.concat_ws(" ", "lang", "source")).alias("base"))
    taken = rows.groupBy(F.lit("en-src0").alias("alias")).agg(F.count("*").alias("n")).select("alias")
    return lifecycle.assign_aliases(proposals, taken)


@query(
    "create_pages",
    f"""WITH {WIKI}, i AS (SELECT page_id AS no, page_id % 6 AS kind FROM pages), good AS (SELECT no FROM i WHERE kind IN (0, 1, 5))
    SELECT (SELECT max(id) FROM wiki) + row_number() OVER (ORDER BY no) AS id, 'Page ' || no AS title, CASE WHEN no % 6 = 1 THEN 'own-' || no ELSE 'page-' || no END AS alias, 'a,b' AS tags FROM good""",
)
def create_pages(spark, folder):
    """An input per captured page: two kinds are fine, others have a bad title, alias, or parent."""
    ident = F.col("page_id")
    kind = ident % 6
    inputs = read_spread(spark, folder, "pages", "page_id").select(
        ident.alias("no"),
        F.when(kind == 2, F.lit(" ")).otherwise(F.concat(F.lit(" Page "), ident.cast("string"))).alias("title"),
        F.when(kind == 1, F.concat(F.lit("Own-"), ident.cast("string"))).when(kind == 3, F.lit("doc-9")).when(kind == 4, F.lit("not valid")).alias("alias"),
        F.when(kind == 5, F.lit(0)).cast("bigint").alias("parent_id"), F.array(F.lit("B"), F.lit(" a"), F.lit("b")).alias("tags"),
    )
    created, _ = lifecycle.create_pages(wiki(spark, folder), inputs, "2024-07-01 00:00:00")
    return created.select("id", "title", "alias", F.array_join("tags", ",").alias("tags"))


@query(
    "create_refusals",
    """SELECT page_id AS no, CASE page_id % 6 WHEN 2 THEN 'title must have 1 to 200 characters' WHEN 3 THEN 'alias already exists' WHEN 4 THEN 'alias must contain lowercase ASCII letters, numbers, and single hyphens' ELSE 'parent page not found' END AS error FROM pages WHERE page_id % 6 IN (2, 3, 4, 5)""",
)
def create_refusals(spark, folder):
    ident = F.col("page_id")
    kind = ident % 6
    inputs = read_spread(spark, folder, "pages", "page_id").select(
        ident.alias("no"),
        F.when(kind == 2, F.lit(" ")).otherwise(F.concat(F.lit(" Page "), ident.cast("string"))).alias("title"),
        F.when(kind == 3, F.lit("doc-9")).when(kind == 4, F.lit("not valid")).alias("alias"),
        F.when(kind == 5, F.lit(-5)).cast("bigint").alias("parent_id"),
    )
    _, refused = lifecycle.create_pages(wiki(spark, folder), inputs, "2024-07-01 00:00:00")
    return refused


@query(
    "delete_pages",
    f"""WITH {WIKI} SELECT id, CASE WHEN deleted_at IS NULL AND id % 2 = 0 THEN 'deleted-page-' || id ELSE alias END AS alias, CASE WHEN id % 2 = 0 AND deleted_at IS NULL THEN 'doc-' || id ELSE deleted_alias END AS deleted_alias, deleted_at IS NOT NULL OR id % 2 = 0 AS deleted FROM wiki""",
)
def delete_pages(spark, folder):
    pages = wiki(spark, folder)
    after = lifecycle.delete_pages(pages, pages.filter(F.col("id") % 2 == 0), "2024-07-01 00:00:00")
    return after.select("id", "alias", "deleted_alias", F.col("deleted_at").isNotNull().alias("deleted"))


@query(
    "restore_pages",
    f"""WITH {WIKI} SELECT id, CASE WHEN deleted_at IS NULL THEN CASE WHEN id % 10 = 0 THEN 'doc-' || (id + 1) ELSE alias END WHEN id % 10 = 1 AND id - 1 IN (SELECT id FROM wiki WHERE deleted_at IS NULL) THEN deleted_alias || '-2' ELSE deleted_alias END AS alias FROM wiki
    WHERE NOT (id % 10 = 1 AND deleted_at IS NULL)""",
)
def restore_pages(spark, folder):
    """Everything comes back from the trash; every tenth live page took the alias of its successor."""
    pages = wiki(spark, folder)
    ident = F.col("id")
    live = F.col("deleted_at").isNull()
    moved = pages.filter(~(live & (ident % 10 == 1))).withColumn("alias", F.when(live & (ident % 10 == 0), F.concat(F.lit("doc-"), (ident + 1).cast("string"))).otherwise(F.col("alias")))
    return lifecycle.restore_pages(moved, filters.deleted(moved), "2024-07-01 00:00:00").select("id", "alias")


@query("purge_pages", f"WITH {WIKI} SELECT 'pages' AS name, count(*) AS value FROM wiki WHERE deleted_at IS NULL OR id % 2 = 1 UNION ALL SELECT 'tags', 2 * count(*) FROM wiki WHERE deleted_at IS NULL OR id % 2 = 1")
def purge_pages(spark, folder):
    pages = wiki(spark, folder)
    left = lifecycle.purge_pages(pages, pages.filter(F.col("id") % 2 == 0), {"tags": (filters.tag_rows(pages), "page_id")})
    return blobs.audit(*[frame.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value") for name, frame in left.items()])


@query(
    "supersede_versions",
    "SELECT conv_id AS document_id, turn AS version, CASE WHEN conv_id % 2 = 0 AND turn % 3 <> 2 THEN 'superseded' ELSE ['queued', 'extracting', 'ready'][turn % 3 + 1] END AS status FROM conversations",
)
def supersede_versions(spark, folder):
    turns = read_spread(spark, folder, "conversations", "conv_id")
    states = F.array(F.lit("queued"), F.lit("extracting"), F.lit("ready"))
    versions = turns.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("version"), F.element_at(states, (F.col("turn") % 3 + 1).cast("int")).alias("status"))
    return queues.superseded(versions, versions.filter(F.col("document_id") % 2 == 0))


@query("queue_incremental_fold", f"WITH {fold_sql(1800, JOB_BACKOFF)} SELECT {SHOWN} FROM queue")
def queue_incremental_fold(spark, folder):
    """The event log in four slices of time, each merged into the state that the slices before left."""
    events = queue_events(spark, folder)
    ends = events.select(F.percentile_approx(F.unix_micros(F.col("at").cast("timestamp")), [0.25, 0.5, 0.75]).alias("ends")).first()["ends"]
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    state = None
    for low, high in zip([None, *ends], [*ends, None]):
        part = events if low is None else events.filter(micros > low)
        part = part if high is None else part.filter(micros <= high)
        state = cut_lineage(queues.merge(state, part))
    return shown(queues.current(state, queues.LEASE_SECONDS["documents"], queues.JOB_POLICY))


@query("queue_stream", f"WITH {fold_sql(1800, JOB_BACKOFF)} SELECT {SHOWN} FROM queue")
def queue_stream(spark, folder):
    """The event log in three files of time, followed by a stream with keyed state."""
    events = queue_events(spark, folder)
    place = own_folder(spark)
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    ends = events.select(F.percentile_approx(micros, [0.5, 0.8]).alias("ends")).first()["ends"]
    for number, (low, high) in enumerate(zip([None, *ends], [*ends, None])):
        part = events if low is None else events.filter(micros > low)
        part = part if high is None else part.filter(micros <= high)
        part.write.parquet(f"{place}/events/{number}")
        arriving = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{place}/events")
        jobs.keep_queue_current(arriving, f"{place}/queue", f"{place}/checkpoint", queues.LEASE_SECONDS["documents"], queues.JOB_POLICY).awaitTermination()
    return shown(jobs.read_queue(spark, f"{place}/queue"))
