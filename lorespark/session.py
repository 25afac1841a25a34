"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "lorespark", shuffle_partitions: int | None = None, more: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Checkpoints are dropped with the frames that use them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (more or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), "lorespark-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


#: Shuffle files go when the action that made them ends, not when the driver collects its garbage.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders that this process has written, and values it has broadcast, and not removed yet.
_written: list[str | Broadcast] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """For frames that are made and used up inside: nothing reads their shuffle files again."""
    before = spark.conf.get(_SHUFFLES_END, None)
    if before is None:  # not known to this version
        yield
        return
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES_END, before)


def own_folder(spark: SparkSession) -> str:
    """A new place in the shared folder, which `release` and `remove_written` take away like a table of `written`."""
    _written.append(f"{shared_folder(spark)}/written-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: for frames of which later readers need parts only.

    `release` takes one of them away again, `remove_written` all of them.
    """
    spark = df.sparkSession
    path = own_folder(spark)
    with own_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast that goes with the tables of its scope."""
    _written.append(spark.sparkContext.broadcast(value))
    return _written[-1]


def release(*things: DataFrame | str | Broadcast) -> None:
    """Remove tables of `written` (given as such or by their folders) and broadcasts that nothing reads any more."""
    for thing in things:
        own = _paths.pop(thing) if isinstance(thing, DataFrame) else thing
        at = next((at for at, one in enumerate(_written) if one is own or one == own), None)
        if at is not None:
            del _written[at]
            _take_away(own)


def _take_away(own: str | Broadcast) -> None:
    if isinstance(own, str):
        _remove(SparkSession.active(), own)
    else:
        own.destroy()


@contextmanager
def recorded() -> Iterator[list[str | Broadcast]]:
    """All tables and broadcasts that are made meanwhile, those released again left out."""
    before, made = {id(one) for one in _written}, []
    yield made
    made += [one for one in _written if id(one) not in before]


def remove_written(spark: SparkSession) -> None:
    """Remove all of them: once their results are stored or no longer wanted."""
    while _written:
        _take_away(_written.pop())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with own_shuffles(spark):
        return df.select("*").checkpoint(eager=True)
