"""A whole archive as one folder, and its way back into a store.

An archive holds the tables, the files (Markdown and blobs) in parts of bounded
bytes, and a manifest with one row for each file and table. Its mark is written
last, so a folder without one is an export that did not end.

A restore stages the tables as a version that nobody reads yet, counts every
problem of archive and staged tables in one job, and makes the version current
only when there is none. Whatever happens before that, the old version stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mime import safe_archive_path
from ..functions.text import sha256_hex
from ..model import RequestError
from ..operators.blobs import blob_path, duplicate_keys, foreign_key_violations, null_violations, verify_archive
from ..session import own_shuffles
from . import tables as store

FORMAT, FORMAT_VERSION = "lorespark-archive", 1
PART_BYTES = 128 << 20
PART = "path string, content binary, sha256 string, size bigint, part string"
MANIFEST = "kind string, name string, path string, sha256 string, size bigint, rows bigint"


def blob_entries(blobs: DataFrame) -> DataFrame:
    """(path, content) of stored blobs (sha256, content), each hash once; copies combine before they move."""
    return blobs.groupBy("sha256").agg(F.any_value("content").alias("content")).select(F.concat(F.lit("blobs/"), blob_path(F.col("sha256"))).alias("path"), "content")


@F.pandas_udf(T.LongType())
def _sum_before(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The sum of the sizes that a task has met before each row."""
    total = 0
    for sizes in batches:
        sums = sizes.cumsum() + total
        yield sums - sizes
        total = int(sums.iloc[-1]) if len(sums) else total


def packed(entries: DataFrame, part_bytes: int) -> DataFrame:
    """Entries (path, content) with hash, size, and the part that holds them; nothing is shuffled.

    A task begins a new part of its own at every `part_bytes` of a running sum,
    so a part is longer by its last file at most. Only sizes go to Python.
    """
    sized = entries.select("path", "content", sha256_hex(F.col("content")).alias("sha256"), F.octet_length("content").cast("bigint").alias("size"))
    number = F.floor(_sum_before("size") / part_bytes)
    return sized.withColumn("part", F.concat_ws("-", F.spark_partition_id().cast("string"), number.cast("string")))


def table_digest(table: DataFrame) -> DataFrame:
    """(digest, rows) of a table, whatever the order of its rows: the sum of sixty bits of each row's SHA-256."""
    row = F.to_json(F.struct(*[F.col(f"`{name}`") for name in sorted(table.columns)]))
    bits = F.conv(F.substring(sha256_hex(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return table.agg(F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest"), F.count("*").alias("rows"))


def write_archive(
    folder: str, tables: dict[str, DataFrame], files: Callable[[dict[str, DataFrame]], DataFrame], blobs: Callable[[dict[str, DataFrame]], DataFrame] | None = None, part_bytes: int = PART_BYTES
) -> None:
    """Write tables, files (path, content) and blobs (sha256, content) into a new folder.

    The tables are written first; `files` and `blobs` are made from them as written, so what a table costs is paid once.
    A null content is an empty file. The content of a file is made once; its hash goes with it and from there into the manifest.
    """
    spark = next(iter(tables.values())).sparkSession
    none = F.lit(None)
    with own_shuffles(spark):
        for name, table in tables.items():
            table.write.parquet(f"{folder}/tables/{name}")
        kept = {name: spark.read.schema(table.schema).parquet(f"{folder}/tables/{name}") for name, table in tables.items()}
        named = lambda frame: frame.select("path", F.coalesce(F.col("content").cast("binary"), F.unhex(F.lit(""))).alias("content"))
        entries = named(files(kept)) if blobs is None else named(files(kept)).unionByName(named(blob_entries(blobs(kept))))
        packed(entries, part_bytes).write.partitionBy("part").parquet(f"{folder}/parts")
        listed = spark.read.schema(PART).parquet(f"{folder}/parts")
        listed.select(F.lit("file").alias("kind"), none.cast("string").alias("name"), "path", "sha256", "size", none.cast("bigint").alias("rows")).write.parquet(f"{folder}/manifest")
        digests = [
            table_digest(table).select(F.lit("table").alias("kind"), F.lit(name).alias("name"), F.lit(f"tables/{name}").alias("path"), F.col("digest").alias("sha256"), none.cast("bigint").alias("size"), "rows")
            for name, table in kept.items()
        ]
        reduce(DataFrame.unionByName, digests).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    spark.createDataFrame([(f"{FORMAT} {FORMAT_VERSION}",)], "mark string").coalesce(1).write.text(f"{folder}/mark")


def archive_manifest(spark: SparkSession, archive: str) -> DataFrame:
    """The manifest of a finished archive; refused when it has no mark or one of another format."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{archive}/mark/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        raise RequestError("invalid_archive", "the archive is not finished")
    mark = spark.read.text(f"{archive}/mark").first()
    if mark is None or mark["value"] != f"{FORMAT} {FORMAT_VERSION}":
        raise RequestError("invalid_archive", f"only {FORMAT} version {FORMAT_VERSION} can be restored")
    return spark.read.schema(MANIFEST).parquet(f"{archive}/manifest")


def archive_files(spark: SparkSession, archive: str) -> DataFrame:
    """(path, content) of all parts."""
    return spark.read.schema(PART).parquet(f"{archive}/parts").select("path", "content")


def archive_summary(manifest: DataFrame) -> DataFrame:
    """(item, n, bytes): files by their first folder, and rows of every table."""
    folder = F.when(F.col("kind") == "file", F.substring_index("path", "/", 1)).otherwise(F.concat(F.lit("table "), F.col("name")))
    return manifest.groupBy(folder.alias("item")).agg(F.sum(F.coalesce("rows", F.lit(1))).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def archive_problems(
    manifest: DataFrame, files: DataFrame, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None,
    references: Iterable[tuple[str, str, str, str]] = (), blob_columns: Iterable[tuple[str, str]] = (),
    max_entries: int | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """(constraint, violations) of all that is wrong with an archive and its tables; no row when nothing is.

    `keys` names the columns that identify a row of a table, `references` holds (table, column, parent, parent's column),
    `blob_columns` (table, column) of hashes that must be among the files. The guards count what is there, not what is listed.
    """
    listed = manifest.filter("kind = 'file'")
    actual = files.select("path", sha256_hex(F.col("content")).alias("sha256"), F.octet_length("content").cast("bigint").alias("size"))
    checks = [verify_archive(listed, actual).groupBy(F.concat(F.lit("file "), "problem").alias("constraint")).agg(F.count("*").alias("violations"))]
    checks += [duplicate_keys(frame, ["path"], name) for frame, name in ((listed, "path listed twice"), (actual, "path found twice"))]
    digest_in_path = F.substring_index("path", "/", -1)
    blob = F.col("path").startswith("blobs/")
    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(True)))
    totals = actual.agg(
        count(~safe_archive_path(F.col("path"))).alias("unsafe path"), F.count_if(blob & (digest_in_path != F.col("sha256"))).alias("blob name"),
        (F.count("*") > max_entries if max_entries is not None else F.lit(False)).cast("bigint").alias("too many entries"),
        F.coalesce(F.sum("size") > max_bytes if max_bytes is not None else F.lit(False), F.lit(False)).cast("bigint").alias("too many bytes"),
    )
    checks.append(totals.unpivot([], totals.columns, "constraint", "violations"))
    stated = manifest.filter("kind = 'table'").select("name", F.col("sha256").alias("_digest"), F.col("rows").alias("_rows"))
    for name, table in tables.items():
        wrong = table_digest(table).join(stated.filter(F.col("name") == name), (F.col("digest") == F.col("_digest")) & F.col("rows").eqNullSafe(F.col("_rows")), "left_anti")
        checks.append(wrong.agg(F.count("*").alias("violations")).select(F.lit(f"table {name}").alias("constraint"), "violations"))
    for name, columns in (keys or {}).items():
        checks += [duplicate_keys(tables[name], columns, f"key {name}"), null_violations(tables[name], columns, f"null key {name}")]
    checks += [foreign_key_violations(tables[name], column, tables[parent], key, f"{name}.{column}") for name, column, parent, key in references]
    stored = actual.filter(blob).select(digest_in_path.alias("sha256"))
    checks += [foreign_key_violations(tables[name], column, stored, "sha256", f"blob of {name}.{column}") for name, column in blob_columns]
    return reduce(DataFrame.unionByName, checks).filter(F.col("violations") > 0)


def restore_archive(spark: SparkSession, archive: str, folder: str, **rules) -> str:
    """Restore the tables of an archive as the next version of a store, and return that version.

    `rules` are those of `archive_problems`. An archive with any problem is refused with all of them named;
    then, and when reading it fails, the staged tables are removed and the current version stays.
    """
    manifest = archive_manifest(spark, archive)
    names = [row["name"] for row in manifest.filter("kind = 'table'").select("name").collect()]
    data = store.stage({name: spark.read.parquet(f"{archive}/tables/{name}") for name in names}, folder)
    try:
        staged = {name: store.staged(spark, folder, data, name) for name in names}
        with own_shuffles(spark):
            found = archive_problems(manifest, archive_files(spark, archive), staged, **rules).collect()
        if found:
            raise RequestError("restore_refused", ", ".join(f"{row['constraint']}: {row['violations']}" for row in sorted(found)))
        return store.commit(spark, folder, data)
    except BaseException:
        store.discard(spark, folder, data)
        raise
