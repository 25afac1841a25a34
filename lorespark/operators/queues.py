"""Durable job queues as an append-only event log.

Events: requested, claimed, renewed, failed, delayed, completed, cancelled.
`fold` turns the log into the current queue. All transitions are sets of new
events, so retried tasks and repeated batches change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MAX_ATTEMPTS, MIN_REFRESH_SECONDS, RequestError
from ..sources.log import EventLog
from .scale import number_within

# Lease lengths in seconds by queue.
LEASE_SECONDS = {"page_vectors": 60, "document_vectors": 60, "documents": 1800, "captures": 300, "research": 600, "tagging": 120}


@dataclass(frozen=True)
class RetryPolicy:
    """Backoff of min(cap, 2^min(attempts, bend)) seconds; `attempts` limits the tries, None means no limit."""

    cap_seconds: int
    bend: int | None
    max_attempts: int | None


VECTOR_POLICY = RetryPolicy(cap_seconds=300, bend=8, max_attempts=None)
JOB_POLICY = RetryPolicy(cap_seconds=60, bend=None, max_attempts=MAX_ATTEMPTS)


def backoff_seconds(attempts: Column, policy: RetryPolicy) -> Column:
    # Powers beyond the cap are all the same, so the exponent is bounded against overflow.
    exponent = F.least(attempts, F.lit(30 if policy.bend is None else policy.bend))
    return F.least(F.lit(policy.cap_seconds), F.pow(F.lit(2), exponent).cast("bigint")).cast("bigint")


def plus_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, moment)


def is_terminal(attempts: Column, policy: RetryPolicy) -> Column:
    return F.lit(False) if policy.max_attempts is None else attempts >= policy.max_attempts


#: What is known of a job besides its last request; all of it can be merged.
LAST = {"claim": ("claimed", ["owner"]), "failure": ("failed", []), "delay": ("delayed", ["delay_seconds"]), "completion": ("completed", []), "cancellation": ("cancelled", [])}


def fold(events: DataFrame, lease_seconds: int, policy: RetryPolicy) -> DataFrame:
    """Current queue: one row per entity that still waits or works.

    `events` has entity_id, at, event_id, kind and, optionally, owner, revision,
    retryable and delay_seconds. An event that names a revision counts only for
    that revision; everything before the last request belongs to an older one. A
    renewal that names an owner counts only for that owner's claim. All aggregates
    combine on the map side, so the size of one entity's history does not matter.
    """
    return current(merge(None, events), lease_seconds, policy)


def merge(state: DataFrame | None, events: DataFrame) -> DataFrame:
    """State of every entity after more events; `state` is what an earlier call returned.

    The events of an entity must be later than those it had before; within one
    call they may come in any order.
    """
    optional = {"owner": "string", "revision": "bigint", "retryable": "boolean", "delay_seconds": "bigint"}
    for name, kind in optional.items():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    position = F.struct("at", "event_id")
    requests = events.filter(F.col("kind") == "requested").groupBy("entity_id").agg(F.max(position).alias("_new"), F.count("*").alias("_times"))
    if state is None:
        known = requests.select("entity_id", F.col("_new").alias("requested"), F.col("_times").alias("revision"), F.lit(True).alias("_fresh"))
    else:
        known = state.join(requests, "entity_id", "full").withColumns({
            "requested": F.coalesce("_new", "requested"), "revision": F.coalesce("revision", F.lit(0)) + F.coalesce("_times", F.lit(0)), "_fresh": F.col("_new").isNotNull(),
        }).drop("_new", "_times")
    later = (
        events.filter(F.col("kind") != "requested")
        .join(known.select("entity_id", F.col("requested").alias("_requested"), F.col("revision").alias("_revision")), "entity_id")
        .filter((position > F.col("_requested")) & (F.col("revision").isNull() | (F.col("revision") == F.col("_revision"))))
    )

    def last(kind: str, values: list[str]) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct(F.col("at"), F.col("event_id"), *[F.col(name) for name in values])))

    summary = later.groupBy("entity_id").agg(
        *[last(kind, values).alias(f"_{name}") for name, (kind, values) in LAST.items()],
        F.count_if(F.col("kind") == "failed").alias("_failures"),
        F.max(F.when((F.col("kind") == "failed") & ~F.coalesce("retryable", F.lit(True)), F.lit(True))).alias("_refused"),
    )
    # A renewal without an owner is one of any; owners of one job are few.
    by_owner = later.filter(F.col("kind") == "renewed").groupBy("entity_id", F.coalesce("owner", F.lit("")).alias("owner")).agg(F.max(position).alias("place"))
    renewals = by_owner.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("owner", "place"))).alias("_renewals"))
    joined = known.join(summary, "entity_id", "left").join(renewals, "entity_id", "left")
    kept = lambda name: F.when(~F.col("_fresh"), F.col(name)) if state is not None else F.lit(None)
    columns = {name: F.greatest(kept(name), F.col(f"_{name}")) if state is not None else F.col(f"_{name}") for name in LAST}
    columns["failures"] = F.coalesce(kept("failures"), F.lit(0)) + F.coalesce("_failures", F.lit(0))
    columns["refused"] = F.coalesce("_refused", kept("refused").cast("boolean"), F.lit(False))
    if state is None:
        columns["renewals"] = F.col("_renewals")
    else:
        old, new = F.coalesce(kept("renewals"), F.create_map().cast("map<string,struct<at:timestamp_ntz,event_id:bigint>>")), F.coalesce("_renewals", F.create_map().cast("map<string,struct<at:timestamp_ntz,event_id:bigint>>"))
        columns["renewals"] = F.map_zip_with(old, new, lambda owner, one, other: F.greatest(one, other))
    return joined.select("entity_id", "requested", F.col("revision").cast("bigint").alias("revision"), *[column.alias(name) for name, column in columns.items()])


def current(state: DataFrame, lease_seconds: int, policy: RetryPolicy) -> DataFrame:
    """The jobs of a state that still wait or work."""
    failures = F.col("failures")
    attempts = failures if policy.max_attempts is None else F.when(F.col("refused"), F.greatest(failures, F.lit(policy.max_attempts))).otherwise(failures)
    released = F.greatest(_place("failure"), _place("delay"))
    held = F.col("claim").isNotNull() & (released.isNull() | (_place("claim") > released))
    renewal = F.greatest(F.try_element_at("renewals", F.lit("")), F.try_element_at("renewals", F.col("claim.owner")))
    renewed = F.when(renewal > _place("claim"), renewal["at"])
    available = F.greatest(
        F.col("requested.at"),
        plus_seconds(F.col("failure.at"), backoff_seconds(attempts, policy)),
        plus_seconds(F.col("delay.at"), F.coalesce(F.col("delay.delay_seconds"), F.lit(1))),
    )
    waiting = state.filter(F.col("completion").isNull() & F.col("cancellation").isNull())
    return waiting.select(
        "entity_id",
        F.col("requested.at").alias("requested_at"),
        available.alias("available_at"),
        attempts.cast("bigint").alias("attempts"),
        "revision",
        F.when(held, F.col("claim.owner")).alias("lease_owner"),
        F.when(held, plus_seconds(F.coalesce(renewed, F.col("claim.at")), F.lit(lease_seconds))).alias("lease_until"),
    )


def _place(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.struct(F.col(f"{column}.at").alias("at"), F.col(f"{column}.event_id").alias("event_id")))


def claimable(queue: DataFrame, now: str | Column, policy: RetryPolicy) -> DataFrame:
    moment = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    waiting = queue.filter((F.col("available_at") <= moment) & (F.col("lease_until").isNull() | (F.col("lease_until") < moment)))
    return waiting if policy.max_attempts is None else waiting.filter(F.col("attempts") < policy.max_attempts)


def claim(queue: DataFrame, now: str, owner: str, policy: RetryPolicy, limit: int = 1) -> DataFrame:
    """Claim events for the oldest `limit` claimable jobs."""
    chosen = claimable(queue, now, policy).orderBy("requested_at", "entity_id").limit(limit)
    return chosen.select("entity_id", F.lit(now).cast("timestamp_ntz").alias("at"), F.lit("claimed").alias("kind"), F.lit(owner).alias("owner"), "revision")


#: Event ids of a batch start at its number times this.
BATCH_IDS = 1 << 24


def take(log: EventLog, now: str, owner: str, policy: RetryPolicy, lease_seconds: int, limit: int = 1, tries: int = 50) -> DataFrame:
    """Claim the oldest `limit` claimable jobs for one owner and nobody else; the claims as they stand in the log.

    The claims are a batch of the log, right after the batches they were chosen
    from. Where another writer was faster, the log is read anew and the choice made
    again, so two workers never hold one job at a time.
    """
    if not 0 < limit < BATCH_IDS:
        raise RequestError(f"limit must be between 1 and {BATCH_IDS - 1}")
    for _ in range(tries):
        number = log.last()
        chosen = claim(fold(log.read(number), lease_seconds, policy), now, owner, policy, limit)
        place = F.row_number().over(Window.orderBy("entity_id"))  # of at most `limit` rows
        events = chosen.withColumn("event_id", (F.lit(number + 1) * BATCH_IDS + place).cast("bigint"))
        names = {field.name: field.dataType for field in log.read(0).schema}
        shaped = events.select(*[(F.col(name) if name in events.columns else F.lit(None)).cast(kind).alias(name) for name, kind in names.items()])
        if log.append(shaped, number + 1):
            return log.read(number + 1, after=number)
    raise TimeoutError(f"{tries} times another writer was faster")


def report(log: EventLog, results: DataFrame, policy: RetryPolicy, lease_seconds: int, tries: int = 50) -> DataFrame:
    """Add the results of a worker (entity_id, at, kind, owner, revision, ...) whose lease still stands; returns those that count.

    The lease is checked against the very batches that the results follow.
    """
    for _ in range(tries):
        number = log.last()
        good = accepted(results, fold(log.read(number), lease_seconds, policy))
        names = {field.name: field.dataType for field in log.read(0).schema}
        numbered = number_within(good.withColumn("_all", F.lit(1)), "_all", "entity_id", name="_place").withColumn("event_id", (F.lit(number + 1) * BATCH_IDS + F.col("_place")).cast("bigint"))
        shaped = numbered.select(*[(F.col(name) if name in numbered.columns else F.lit(None)).cast(kind).alias(name) for name, kind in names.items()])
        if log.append(shaped, number + 1):
            return log.read(number + 1, after=number)
    raise TimeoutError(f"{tries} times another writer was faster")


def accepted(results: DataFrame, queue: DataFrame, check_owner: bool = True) -> DataFrame:
    """Results whose lease is still current: same revision and, usually, same owner."""
    lease = queue.select("entity_id", F.col("revision").alias("_revision"), F.col("lease_owner").alias("_owner"))
    joined = results.join(lease, "entity_id").filter(F.col("revision") == F.col("_revision"))
    if check_owner:
        joined = joined.filter(F.col("owner") == F.col("_owner"))
    return joined.drop("_revision", "_owner")


def failure_states(queue: DataFrame, policy: RetryPolicy, now: str, retryable: Column | None = None) -> DataFrame:
    """What one more failure now would do to every job: attempts, next try, final state."""
    moment = F.lit(now).cast("timestamp_ntz")
    tried = F.col("attempts") + 1
    if retryable is not None and policy.max_attempts is not None:
        tried = F.when(retryable, tried).otherwise(F.lit(policy.max_attempts))
    return queue.withColumn("attempts", tried).withColumn("available_at", plus_seconds(moment, backoff_seconds(F.col("attempts"), policy))).withColumn(
        "status", F.when(is_terminal(F.col("attempts"), policy), F.lit("failed")).otherwise(F.lit("queued"))
    ).withColumn("lease_owner", F.lit(None).cast("string")).withColumn("lease_until", F.lit(None).cast("timestamp_ntz"))


# States from which a person may cancel or retry.
CANCELLABLE = {"documents": ("queued", "extracting"), "captures": ("queued", "fetching", "transcribing"), "research": ("queued", "researching")}
RETRYABLE = {"documents": ("failed", "cancelled"), "captures": ("failed", "cancelled"), "research": ("failed", "cancelled")}


def transition(entities: DataFrame, queue: str, action: str, extra: list[str] = ()) -> DataFrame:
    """(id, status, extra columns, allowed, new_status) for a cancel or a retry of every given entity."""
    states = CANCELLABLE if action == "cancel" else RETRYABLE
    allowed = F.col("status").isin(*states[queue])
    if queue == "documents" and action == "retry" and "needs_ocr" in entities.columns:
        allowed = allowed | ((F.col("status") == "ready") & F.col("needs_ocr"))
    target = "cancelled" if action == "cancel" else "queued"
    return entities.select("id", "status", *extra, allowed.alias("allowed"), F.when(allowed, F.lit(target)).otherwise(F.col("status")).alias("new_status"))


def check_interval(seconds: int | None) -> int | None:
    if seconds is not None and (type(seconds) is not int or seconds < MIN_REFRESH_SECONDS):
        raise RequestError("invalid_refresh_interval", "refresh interval must be null or at least 300 seconds")
    return seconds


def due_refreshes(captures: DataFrame, live_pages: DataFrame, now: str) -> DataFrame:
    """Captures whose refresh time has come and that are not on their way already."""
    moment = F.lit(now).cast("timestamp_ntz")
    due = captures.filter(F.col("refresh_interval_seconds").isNotNull() & (F.col("next_refresh_at") <= moment) & ~F.col("status").isin("queued", "fetching"))
    return due.join(live_pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")


def next_refresh(captures: DataFrame, finished_at: Column) -> DataFrame:
    return captures.withColumn("next_refresh_at", plus_seconds(finished_at, F.col("refresh_interval_seconds")))


def requeue_for_config(current: dict | None, wanted: dict, entities: DataFrame, now: str) -> DataFrame | None:
    """Request events for everything when an index parameter changed; None when nothing changed."""
    if current is not None and all(current.get(name) == value for name, value in wanted.items()):
        return None
    return request(entities, now)


def request(entities: DataFrame, now: str, key: str = "id") -> DataFrame:
    return entities.select(F.col(key).alias("entity_id"), F.lit(now).cast("timestamp_ntz").alias("at"), F.lit("requested").alias("kind"))


def superseded(versions: DataFrame, replaced: DataFrame) -> DataFrame:
    """Versions after a replacement: unfinished versions of replaced documents are superseded."""
    marked = versions.join(replaced.select("document_id", F.lit(True).alias("_replaced")).distinct(), "document_id", "left")
    unfinished = F.col("_replaced") & F.col("status").isin("queued", "extracting")
    return marked.withColumn("status", F.when(unfinished, F.lit("superseded")).otherwise(F.col("status"))).drop("_replaced")


def without_documents(index_rows: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Index rows that remain after the listed documents were replaced or removed."""
    return index_rows.join(documents.select(key), key, "left_anti")
