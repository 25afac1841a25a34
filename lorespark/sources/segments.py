"""A table kept by segments: what changes is written, not what stays.

Every batch of changed and removed keys becomes one segment, whose files are sorted,
each by itself: rows are computed once and not shuffled for it. A key's
rows are those of the newest segment that names it; a removed key is named by a
tombstone. A manifest lists the segments; the next manifest is created under the
next number, which only one writer can do, so readers see whole batches and two
writers never lose each other's.

From the first segment that does not hold at least GROWTH times as many keys as
all newer ones together, segments are merged into one. So n keys lie in about log(n) segments,
and a row is written again about log(n) times in its life.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import own_shuffles
from .log import NumberedFiles

GROWTH = 2


@dataclass(frozen=True)
class Segment:
    name: str
    order: int
    keys: int


class SegmentedTable:
    """Rows by key. `key` may have many rows; `mark` holds for exactly one of them in each segment.

    A batch names each key once: changed or removed, not both. A null key takes no
    part. `sort` is the order inside a segment, which lets scans skip row groups.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, sort: list[str], mark: Column | None = None) -> None:
        self.spark, self.folder, self.key, self.sort = spark, folder, key, sort
        self.schema = f"{schema}, _gone boolean"
        self.mark = F.lit(True) if mark is None else mark
        self._manifests = NumberedFiles(spark, f"{folder}/manifests")
        self._empty = spark.createDataFrame([], self.schema)

    def _manifest(self) -> tuple[int, list[Segment], int]:
        number = self._manifests.last()
        if not number:
            return 0, [], -1
        found = json.loads(self._manifests.read(number))
        return number, [Segment(**one) for one in found["segments"]], found["applied"]

    def _publish(self, number: int, segments: list[Segment], applied: int) -> bool:
        return self._manifests.create(number, json.dumps({"segments": [asdict(one) for one in segments], "applied": applied}))

    def _data(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{name}")

    def _store(self, rows: DataFrame) -> tuple[str, int]:
        """Write a segment; its name and its number of keys."""
        name, seen = uuid.uuid4().hex, Observation()
        placed = rows.sortWithinPartitions(*self.sort).observe(seen, F.count_if(self.mark | F.col("_gone")).alias("keys"))
        with own_shuffles(self.spark):
            placed.write.parquet(f"{self.folder}/data/{name}")
        return name, seen.get["keys"]

    def segments(self) -> list[Segment]:
        """Oldest first."""
        return self._manifest()[1]

    def applied(self) -> int:
        """The newest batch number that counts; -1 before the first."""
        return self._manifest()[2]

    def append(self, rows: DataFrame | None = None, removed: DataFrame | None = None, batch: int | None = None, tries: int = 50) -> bool:
        """Rows of changed keys, and the keys that go. A batch number that counts already changes nothing.

        Numbered batches must come in order; False means that this one had come before.
        """
        if batch is not None and batch <= self.applied():
            return False
        new = self._empty if rows is None else rows.withColumn("_gone", F.lit(False)).select(self._empty.columns)
        if removed is not None:
            gone = removed.select(F.col(self.key), F.lit(True).alias("_gone")).distinct()
            new = new.unionByName(gone, allowMissingColumns=True)
        name, keys = self._store(new.filter(F.col(self.key).isNotNull()))
        for _ in range(tries):
            number, segments, applied = self._manifest()
            if batch is not None and batch <= applied:
                self._manifests.delete(f"{self.folder}/data/{name}")
                return False
            own = [Segment(name, segments[-1].order + 1 if segments else 0, keys)] if keys else []
            if self._publish(number + 1, segments + own, applied if batch is None else batch):
                self.compact()
                return True
        raise RuntimeError(f"{tries} other writers were faster")

    def compact(self) -> bool:
        """Merge the newest segments as far as GROWTH asks; without effect where another writer is faster."""
        number, segments, applied = self._manifest()
        sizes = [one.keys for one in segments]
        start = next((at for at, size in enumerate(sizes) if size < GROWTH * sum(sizes[at + 1 :])), None)
        if start is None:
            return False
        # A tombstone is needed as long as an older segment may name its key.
        name, keys = self._store(self._merged(segments[start:], tombstones=start > 0))
        if self._publish(number + 1, segments[:start] + [Segment(name, segments[-1].order, keys)], applied):
            return True
        self._manifests.delete(f"{self.folder}/data/{name}")
        return False

    def vacuum(self) -> None:
        """Remove what the newest manifest does not need; readers of older ones must have ended, and no writer be at work."""
        number, segments, _ = self._manifest()
        kept = {one.name for one in segments}
        for older in [one for one in self._manifests.numbers() if one < number]:
            for one in json.loads(self._manifests.read(older))["segments"]:
                if one["name"] not in kept:
                    self._manifests.delete(f"{self.folder}/data/{one['name']}")
            self._manifests.delete(f"{self._manifests.folder}/{older:012d}")

    def _merged(self, segments: list[Segment], tombstones: bool) -> DataFrame:
        parts = [self._data(one.name).withColumn("_order", F.lit(one.order)) for one in segments]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if len(parts) > 1:
            # Only keys that newer segments name can be out of date; the oldest, largest segment is not among them.
            named = parts[1]
            for part in parts[2:]:
                named = named.unionByName(part)
            newest = named.filter(self.mark | F.col("_gone")).groupBy(F.col(self.key).alias("_key")).agg(F.max("_order").alias("_newest"))
            rows = rows.join(newest, (F.col(self.key) == F.col("_key")) & (F.col("_order") < F.col("_newest")), "left_anti")
        return (rows if tombstones else rows.filter(~F.col("_gone"))).drop("_order")

    def read(self) -> DataFrame:
        """Rows of all keys as they are now."""
        segments = self.segments()
        return (self._merged(segments, tombstones=False) if segments else self._empty).drop("_gone")
