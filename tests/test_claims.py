import datetime

import pytest
from pyspark.sql import functions as F

from lorespark.operators import queues
from lorespark.sources.log import EventLog

SCHEMA = "entity_id long, at timestamp_ntz, event_id long, kind string, owner string, revision long"
NOW, LATER = "2024-01-01 12:00:00", "2024-01-01 13:00:00"
T0 = datetime.datetime(2024, 1, 1)


def new_log(spark, folder, jobs=4):
    log = EventLog(spark, str(folder), SCHEMA)
    assert log.last() == 0 and log.read().count() == 0
    assert log.append(spark.createDataFrame([(n, T0 + datetime.timedelta(minutes=n), n, "requested", None, None) for n in range(1, jobs + 1)], SCHEMA), 1)
    return log


def take(log, owner, now=NOW, limit=2):
    return sorted(row.entity_id for row in queues.take(log, now, owner, queues.JOB_POLICY, 60, limit).collect())


def test_a_number_is_taken_once(spark, tmp_path):
    log = new_log(spark, tmp_path)
    events = spark.createDataFrame([(9, T0, 99, "requested", None, None)], SCHEMA)
    assert not log.append(events, 1) and log.append(events, 2) and log.last() == 2
    assert log.read().count() == 5 and log.read(1).count() == 4 and log.read(2, after=1).count() == 1


def test_two_workers_never_hold_one_job(spark, tmp_path):
    log = new_log(spark, tmp_path)

    class Overtaken(EventLog):
        """Between choice and commit of the first worker another one takes its jobs."""

        def append(self, events, number):
            if not hasattr(self, "others"):
                self.others = take(log, "second")
            return super().append(events, number)

    mine = take(Overtaken(spark, str(tmp_path), SCHEMA), "first")
    claims = log.read().filter("kind = 'claimed'").collect()
    assert mine == [3, 4] and len(claims) == 4 and len({row.entity_id for row in claims}) == 4
    assert {row.entity_id: row.owner for row in claims} == {1: "second", 2: "second", 3: "first", 4: "first"}
    assert take(log, "third") == []
    assert take(log, "third", LATER, 4) == [1, 2, 3, 4]  # all leases have run out
    assert log.read().groupBy("event_id").count().filter("count > 1").count() == 0


def test_results_count_while_the_lease_stands(spark, tmp_path):
    log = new_log(spark, tmp_path)
    assert take(log, "first") == [1, 2]
    done = lambda owner, at: spark.createDataFrame([(1, at, "completed", owner, 1), (2, at, "completed", owner, 7), (3, at, "completed", owner, 1)], "entity_id long, at timestamp_ntz, kind string, owner string, revision long")
    moment = datetime.datetime(2024, 1, 1, 12, 0, 30)
    counted = queues.report(log, done("second", moment), queues.JOB_POLICY, 60)
    assert counted.count() == 0
    counted = queues.report(log, done("first", moment), queues.JOB_POLICY, 60)
    assert [row.entity_id for row in counted.collect()] == [1]
    left = queues.fold(log.read(), 60, queues.JOB_POLICY).filter(F.col("lease_owner").isNotNull()).collect()
    assert [row.entity_id for row in left] == [2]


def test_unfinished_batches_are_named(spark, tmp_path, monkeypatch):
    log = new_log(spark, tmp_path)
    (tmp_path / "batches" / f"{2:012d}").write_text("")
    monkeypatch.setattr("lorespark.sources.log.PATIENCE", 0.5)
    with pytest.raises(RuntimeError, match="no content"):
        log.read()
