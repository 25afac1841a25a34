"""An event log in numbered batches, of which only one writer can add the next.

The events of a batch are written first, under a name of their own. The batch
then counts from the moment in which the file of its number is created, which
fails when another writer was there before. A writer names the number after the
last one it has read, so it can only add to a log that it has seen whole.

The folder must be on a file system that creates a file for one caller only, as
HDFS and object stores with conditional writes do.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Seconds that a reader waits for a writer between the name of a batch and its content.
PATIENCE = 30


class NumberedFiles:
    """Small text files named by numbers; each number is created by one writer only."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        place = self._path(self.folder)
        return sorted(int(entry.getPath().getName()) for entry in self._files.listStatus(place)) if self._files.exists(place) else []

    def last(self) -> int:
        """The newest number; 0 before the first."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> str:
        until = time.monotonic() + PATIENCE
        while time.monotonic() < until:
            file = self._files.open(self._path(f"{self.folder}/{number:012d}"))
            line = self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
            file.close()
            if line:
                return line
            time.sleep(0.2)
        raise RuntimeError(f"number {number} has a name and no content: its writer was lost; remove the file to go on")

    def create(self, number: int, line: str) -> bool:
        """False if another writer has taken the number."""
        try:
            file = self._files.create(self._path(f"{self.folder}/{number:012d}"), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        file.write(bytearray(line, "utf-8"))
        file.close()
        return True

    def delete(self, path: str) -> None:
        self._files.delete(self._path(path), True)


class EventLog:
    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema
        self._batches = NumberedFiles(spark, f"{folder}/batches")

    def last(self) -> int:
        """The number of the newest batch; 0 before the first."""
        return self._batches.last()

    def read(self, upto: int | None = None, after: int = 0) -> DataFrame:
        """Events of the batches after one number up to another (the newest)."""
        numbers = range(after + 1, (self.last() if upto is None else upto) + 1)
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{self._batches.read(number)}" for number in numbers])

    def append(self, events: DataFrame, number: int) -> bool:
        """Add a batch under a number; False if another writer has taken it."""
        name = uuid.uuid4().hex
        events.write.parquet(f"{self.folder}/data/{name}")
        if self._batches.create(number, name):
            return True
        self._batches.delete(f"{self.folder}/data/{name}")
        return False
