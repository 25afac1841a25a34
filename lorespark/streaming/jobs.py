"""Continuous forms: queue logs, change capture and ingestion as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import Settings
from ..operators.chunks import explode_sections
from ..operators.queues import LAST, RetryPolicy, current
from ..session import release, written
from ..sources.files import extract_files
from ..sources.segments import SegmentedTable


def read_events(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Event files that appear in a folder, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', at)"
MARKS = list(LAST)
JOB_STATE = (
    "requested_at bigint, requested_id bigint, revision bigint, failures bigint, refused boolean, "
    + ", ".join(f"{name}_at bigint, {name}_id bigint" for name in MARKS)
    + ", claim_owner string, delay_seconds bigint"
)
RENEWALS = "array<struct<owner:string,at:bigint,event_id:bigint>>"
NEVER = (-(2**63), -(2**63))


_MARK_OF = {kind: name for name, (kind, _) in LAST.items()}


def _events(frame: pd.DataFrame) -> Iterator[tuple]:
    """(at, event_id, kind, owner, revision, retryable, delay_seconds) of each row, None for a null."""

    def column(name: str, kind=None) -> list:
        return [None if value is None or value != value else kind(value) if kind else value for value in frame[name].tolist()]

    return zip(column("at", int), column("event_id", int), column("kind"), column("owner"), column("revision", int), column("retryable", bool), column("delay_seconds", int))


class QueueProcessor(StatefulProcessor):
    """What `queues.merge` knows of a job, as keyed state: a batch writes the state of the jobs it touches.

    Output: the new state of every touched job. `retention_seconds` after a job was
    completed or cancelled its state goes; a later request then counts as the
    first one. None keeps it for ever, and the queue is exactly the fold of its log.
    A task holds the events that one micro-batch has for one job.
    """

    def __init__(self, retention_seconds: int | None):
        self.retention = retention_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", f"{JOB_STATE}, renewals {RENEWALS}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Plain values: a job has few events in a batch, and one read and one write of its state.
        events = sorted((event for frame in rows for event in _events(frame)), key=lambda event: event[:2])
        names = [part.split()[0] for part in JOB_STATE.split(", ")]
        held = self.job.get()
        job = dict(zip(names, held)) if held is not None else dict.fromkeys(names)
        renewals = {one[0]: (one[1], one[2]) for one in held[len(names)]} if held is not None else {}
        requests = [event for event in events if event[2] == "requested"]
        if requests:
            revision = (job["revision"] or 0) + len(requests)
            job = dict.fromkeys(names) | {"revision": revision, "failures": 0, "refused": False}
            job["requested_at"], job["requested_id"] = requests[-1][:2]
            renewals = {}
        if job["requested_at"] is None:
            return
        since = (job["requested_at"], job["requested_id"])
        for at, event_id, kind, owner, revision, retryable, delay in events:
            if kind == "requested" or (at, event_id) <= since or (revision is not None and revision != job["revision"]):
                continue
            name = _MARK_OF.get(kind)
            if name and (job[f"{name}_at"] is None or (at, event_id) > (job[f"{name}_at"], job[f"{name}_id"])):
                job[f"{name}_at"], job[f"{name}_id"] = at, event_id
                if name == "claim":
                    job["claim_owner"] = owner
                elif name == "delay":
                    job["delay_seconds"] = delay
            if kind == "failed":
                job["failures"] += 1
                job["refused"] = job["refused"] or retryable is False  # a null counts as retryable
            elif kind == "renewed" and (at, event_id) > renewals.get(owner or "", NEVER):
                renewals[owner or ""] = (at, event_id)
        listed = [(owner, *place) for owner, place in renewals.items()]
        self.job.update((*[job[name] for name in names], listed))
        if self.retention is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if job["completion_at"] is not None or job["cancellation_at"] is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retention * 1000)
        values = {"entity_id": [key[0]]} | {name: pd.array([job[name]], dtype="Int64") if name not in ("refused", "claim_owner") else [job[name]] for name in names}
        yield pd.DataFrame(values | {"renewals": [[{"owner": owner, "at": at, "event_id": event_id} for owner, at, event_id in listed]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        yield from ()

    def close(self) -> None:
        pass


def queue_states(events: DataFrame, retention_seconds: int | None = None) -> DataFrame:
    """Stream of the states of jobs as their events come in; `as_state` gives them the form of `queues.merge`."""
    optional = {"owner": "string", "revision": "bigint", "retryable": "boolean", "delay_seconds": "bigint"}
    shaped = events.select("entity_id", F.expr(MICROS).alias("at"), "event_id", "kind", *[(F.col(name) if name in events.columns else F.lit(None)).cast(kind).alias(name) for name, kind in optional.items()])
    return shaped.groupBy("entity_id").transformWithStateInPandas(
        QueueProcessor(retention_seconds), outputStructType=f"entity_id bigint, {JOB_STATE}, renewals {RENEWALS}", outputMode="update", timeMode="none" if retention_seconds is None else "processingTime"
    )


def as_state(states: DataFrame) -> DataFrame:
    def moment(micros: Column) -> Column:
        return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))

    def place(name: str, *values: str) -> Column:
        known = F.struct(moment(F.col(f"{name}_at")).alias("at"), F.col(f"{name}_id").alias("event_id"), *[F.col(column).alias(value) for column, value in zip(values, LAST.get(name, ("", []))[1])])
        return F.when(F.col(f"{name}_at").isNotNull(), known).alias(name)

    extra = {"claim": ["claim_owner"], "delay": ["delay_seconds"]}
    renewals = F.map_from_entries(F.transform("renewals", lambda one: F.struct(one["owner"], F.struct(moment(one["at"]).alias("at"), one["event_id"].alias("event_id")))))
    return states.select("entity_id", place("requested"), "revision", *[place(name, *extra.get(name, [])) for name in MARKS], "failures", "refused", renewals.alias("renewals"))


QUEUE = "entity_id bigint, requested_at timestamp_ntz, available_at timestamp_ntz, attempts bigint, revision bigint, lease_owner string, lease_until timestamp_ntz"


def queue_table(spark: SparkSession, folder: str) -> SegmentedTable:
    return SegmentedTable(spark, folder, QUEUE, "entity_id", ["entity_id"])


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after the last batch that `keep_queue_current` has published."""
    return queue_table(spark, folder).read()


def keep_queue_current(events: DataFrame, folder: str, checkpoint: str, lease_seconds: int, policy: RetryPolicy, retention_seconds: int | None = None):
    """Follow the events and publish the queue: each micro-batch writes the jobs that it touches, and no others.

    The state of a job is kept by key; the queue is a table of segments, in which
    finished jobs are tombstones until they are merged away. A repeated batch
    starts from the same state and is published once. Events of one job must
    arrive in later batches than those before them; inside a batch in any order.
    """
    def handle(batch: DataFrame, number: int) -> None:
        table = queue_table(batch.sparkSession, folder)
        if number <= table.applied():
            return
        # Written once, as changes and removals both read it; the state is not advanced twice.
        states = written(as_state(batch))
        gone = states.filter(F.col("completion").isNotNull() | F.col("cancellation").isNotNull())
        table.append(current(states, lease_seconds, policy), gone, number)
        table.vacuum()
        release(states)

    # Keyed state needs this store. Timers are looked at when events come: batches without events would never end.
    needed = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    conf = events.sparkSession.conf
    before = {name: conf.get(name) for name in needed}
    for name, value in needed.items():
        conf.set(name, value)
    try:  # a stream keeps the settings that it was started with
        return queue_states(events, retention_seconds).writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.set(name, value)


def ingest_documents(files: DataFrame, settings: Settings, sections_path: str, checkpoint: str):
    """Documents that arrive as files become section rows; failures keep their reason."""

    def handle(batch: DataFrame, number: int) -> None:
        extracted = extract_files(batch, settings)
        good = explode_sections(extracted.filter(F.col("error").isNull()), F.col("sections"), ["file_id", "format"])
        good.write.mode("overwrite").parquet(f"{sections_path}/sections/batch={number}")
        extracted.filter(F.col("error").isNotNull()).select("file_id", "error").write.mode("overwrite").parquet(f"{sections_path}/rejected/batch={number}")

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LeaseProcessor(StatefulProcessor):
    """Live view of one queue: keyed state with a timer that returns a job when its lease runs out.

    Output: entity_id, kind (claimed, done, failed, expired), attempts, at.
    """

    OUTPUT = T.StructType(
        [T.StructField("entity_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("attempts", T.LongType()), T.StructField("at", T.TimestampType())]
    )

    def __init__(self, lease_seconds: int, max_attempts: int):
        self.lease_ms = lease_seconds * 1000
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", T.StructType([T.StructField("attempts", T.LongType()), T.StructField("leased", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        attempts, leased = self.job.get() if self.job.exists() else (0, False)
        out = []
        for kind, at in zip(events["kind"], events["at"]):
            if kind == "requested":
                attempts, leased = 0, False
            elif kind == "claimed" and not leased and attempts < self.max_attempts:
                leased = True
                out.append((key[0], "claimed", attempts, at))
            elif kind == "failed" and leased:
                attempts, leased = attempts + 1, False
                out.append((key[0], "failed", attempts, at))
            elif kind == "completed" and leased:
                attempts, leased = 0, False
                out.append((key[0], "done", attempts, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if leased:
            self.handle.registerTimer(int(events["at"].iloc[-1].timestamp() * 1000) + self.lease_ms)
        self.job.update((attempts, leased))
        yield pd.DataFrame(out, columns=self.OUTPUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, leased = self.job.get()
        if leased:
            self.job.update((attempts, False))
            yield pd.DataFrame([(key[0], "expired", attempts, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))], columns=self.OUTPUT.names)

    def close(self) -> None:
        pass


def watch_leases(events: DataFrame, lease_seconds: int, max_attempts: int, lateness: str = "10 minutes") -> DataFrame:
    """Event-time lease view; `events` has entity_id, at (timestamp), event_id, kind."""
    marked = events.withWatermark("at", lateness)
    return marked.groupBy("entity_id").transformWithStateInPandas(
        LeaseProcessor(lease_seconds, max_attempts), outputStructType=LeaseProcessor.OUTPUT, outputMode="append", timeMode="eventTime"
    )
