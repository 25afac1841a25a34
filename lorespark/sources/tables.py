"""Reading tables, and publishing a new snapshot of a table by one pointer file."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Session setting by which a caller asks for its tables in that many partitions.
INPUT_PARTITIONS = "spark.lorespark.inputPartitions"


def read_spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table whose rows are heavy to process.

    It is read as it is. Only a caller who knows that the file is one row group,
    and so one task, states a partition count in INPUT_PARTITIONS.
    """
    table = read_table(spark, folder, name)
    wanted = spark.conf.get(INPUT_PARTITIONS, None)
    return table.repartition(int(wanted), key) if wanted else table


def stage(tables: dict[str, DataFrame], folder: str) -> str:
    """Write all tables into a new data folder that no version names yet, and return its name."""
    data = uuid.uuid4().hex
    try:
        for name, frame in tables.items():
            frame.write.parquet(f"{folder}/data/{data}/{name}")
    except BaseException:
        discard(next(iter(tables.values())).sparkSession, folder, data)
        raise
    return data


def staged(spark: SparkSession, folder: str, data: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data/{data}/{name}")


def discard(spark: SparkSession, folder: str, data: str) -> None:
    """Remove staged tables that shall not become a version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data/{data}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def commit(spark: SparkSession, folder: str, data: str) -> str:
    """Name staged tables as the next version."""
    number = max(_numbers(spark, folder), default=0) + 1
    while True:
        try:
            spark.createDataFrame([(data,)], "data string").coalesce(1).write.mode("error").text(f"{folder}/versions/{number:012d}")
            return f"{number:012d}"
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Write all tables into a new version folder, then name it as the next version.

    Readers keep the version they opened. Versions are numbered; the name of a
    version is a folder that only one writer can create, so two writers at once
    never take the same number, and a lost job leaves the previous one current.
    """
    return commit(next(iter(tables.values())).sparkSession, folder, stage(tables, folder))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [entry.getPath() for entry in files.listStatus(path)]
    return [int(entry.getName()) for entry in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(entry, "_SUCCESS"))]


def current_version(spark: SparkSession, folder: str) -> str:
    """The finished version with the largest number."""
    return f"{max(_numbers(spark, folder)):012d}"


def open_version(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    data = spark.read.text(f"{folder}/versions/{version or current_version(spark, folder)}").first()["value"]
    return spark.read.parquet(f"{folder}/data/{data}/{name}")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows with those of `changes` in place of equal keys."""
    return current.join(changes.select(keys).distinct(), keys, "left_anti").unionByName(changes)
