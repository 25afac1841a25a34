import datetime
import os
import random

from pyspark.sql import functions as F

from lorespark.model import Settings
from lorespark.operators import queues
from lorespark.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "entity_id long, at timestamp_ntz, event_id long, kind string, owner string"


def write(spark, folder, name, rows):
    frame = spark.createDataFrame([(e, T0 + datetime.timedelta(seconds=s), n, kind, "w") for e, s, n, kind in rows], SCHEMA)
    frame.coalesce(1).write.parquet(f"{folder}/{name}")


def test_queue_follows_its_event_files(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, source, "a", [(1, 0, 1, "requested"), (2, 0, 2, "requested"), (1, 5, 3, "claimed")])
    read = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
    jobs.keep_queue_current(read(), out, str(tmp_path / "ck"), 60, queues.JOB_POLICY).awaitTermination()
    write(spark, source, "b", [(1, 9, 4, "completed"), (2, 9, 5, "failed")])
    jobs.keep_queue_current(read(), out, str(tmp_path / "ck"), 60, queues.JOB_POLICY).awaitTermination()
    rows = [(row["entity_id"], row["attempts"]) for row in jobs.read_queue(spark, out).collect()]
    assert rows == [(2, 1)]


KINDS = ["requested", "claimed", "claimed", "renewed", "renewed", "failed", "delayed", "completed", "cancelled"]
FULL = SCHEMA + ", revision long, retryable boolean, delay_seconds long"


def random_events(rng, count):
    for number in range(count):
        kind = rng.choice(KINDS)
        yield (
            rng.randrange(25), T0 + datetime.timedelta(seconds=number // 3), rng.choice([number, 10**6 - number]), kind, rng.choice(["a", "b", None]),
            rng.choice([None, None, 1, 2]), rng.choice([None, True, True, False]) if kind == "failed" else None, rng.choice([None, 7]) if kind == "delayed" else None,
        )


def test_keyed_state_equals_the_fold(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = list(random_events(random.Random(2), 600))
    cuts = [0, 300, 420, 600]  # between seconds, so that no event is earlier than one of a batch before
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = events[low:high]
        random.Random(number).shuffle(part)
        spark.createDataFrame(part, FULL).repartition(3).write.parquet(f"{source}/{number}")
        stream = spark.readStream.schema(FULL).option("recursiveFileLookup", "true").parquet(source)
        jobs.keep_queue_current(stream, out, str(tmp_path / "ck"), 60, queues.JOB_POLICY).awaitTermination()
        folded = queues.fold(spark.createDataFrame(events[:high], FULL), 60, queues.JOB_POLICY)
        names = folded.columns
        assert sorted(map(repr, jobs.read_queue(spark, out).select(names).collect())) == sorted(map(repr, folded.collect()))


def test_a_batch_writes_the_jobs_it_touches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
    write(spark, source, "a", [(number, 0, number, "requested") for number in range(200)])
    jobs.keep_queue_current(read(), out, str(tmp_path / "ck"), 60, queues.JOB_POLICY, 0).awaitTermination()
    write(spark, source, "b", [(7, 5, 300, "completed"), (8, 5, 301, "claimed"), (999, 5, 302, "claimed")])
    jobs.keep_queue_current(read(), out, str(tmp_path / "ck"), 60, queues.JOB_POLICY, 0).awaitTermination()
    assert [one.keys for one in jobs.queue_table(spark, out).segments()] == [200, 2]
    # The finished job has left the state by now, so that this is its first request.
    write(spark, source, "c", [(9, 9, 400, "claimed")])
    jobs.keep_queue_current(read(), out, str(tmp_path / "ck"), 60, queues.JOB_POLICY, 0).awaitTermination()
    write(spark, source, "d", [(7, 20, 500, "requested"), (8, 20, 501, "requested")])
    jobs.keep_queue_current(read(), out, str(tmp_path / "ck"), 60, queues.JOB_POLICY, 0).awaitTermination()
    rows = {row["entity_id"]: row["revision"] for row in jobs.read_queue(spark, out).collect()}
    assert len(rows) == 200 and (rows[7], rows[8], rows[9]) == (1, 2, 1) and 999 not in rows


def test_documents_arrive(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "file_id string, filename string, mime string, content binary"
    spark.createDataFrame([("1", "a.txt", "text/plain", bytearray(b"hello")), ("2", "b.doc", "", bytearray(b"x"))], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    jobs.ingest_documents(stream, Settings(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [row["text"] for row in spark.read.parquet(str(tmp_path / "out" / "sections")).collect()] == ["hello"]
    assert [row["file_id"] for row in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()] == ["2"]


def test_lease_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "in")
    write(spark, source, "a", [(1, 0, 1, "requested"), (1, 5, 2, "claimed"), (2, 0, 3, "requested"), (2, 1, 4, "claimed"), (2, 2, 5, "completed")])
    read = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source).withColumn("at", F.col("at").cast("timestamp"))

    def run():
        view = jobs.watch_leases(read(), 60, 3, "0 seconds")
        view.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    run()
    write(spark, source, "b", [(3, 4000, 6, "requested")])
    run()
    write(spark, source, "c", [(3, 5000, 7, "claimed")])
    run()
    rows = sorted((row["entity_id"], row["kind"]) for row in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(1, "claimed"), (1, "expired"), (2, "claimed"), (2, "done"), (3, "claimed")]


def test_written_tables_are_removed(spark):
    from lorespark import session

    table = session.written(spark.range(3))
    path = session._written[-1].removeprefix("file:")
    assert table.count() == 3 and os.path.isdir(path)
    session.remove_written(spark)
    assert not os.path.exists(path)
