"""Content-addressed blobs, archive verification, and consistency audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mime import image_mime, normalize_mime
from ..functions.text import sha256_hex


def addressed(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with sha256 and size."""
    data = F.col(content).cast("binary")
    return files.withColumn("sha256", sha256_hex(data)).withColumn("size", F.octet_length(data).cast("bigint"))


def new_blobs(files: DataFrame, stored: DataFrame, content: str = "content", mime: str = "mime") -> DataFrame:
    """One row per content that is not stored yet. Copies collapse before the shuffle; the bytes stay behind."""
    hashed = addressed(files, content).withColumn("mime_type", F.coalesce(image_mime(F.col(content).cast("binary")), normalize_mime(F.col(mime))))
    first = hashed.groupBy("sha256").agg(F.max("size").alias("size"), F.min("mime_type").alias("mime_type"), F.count("*").alias("copies"))
    return first.join(stored.select("sha256"), "sha256", "left_anti").withColumn("inline_safe", F.col("mime_type").startswith("image/"))


def referenced_hashes(*referrers: DataFrame) -> DataFrame:
    """Distinct sha256 over all referring tables; each is made distinct on its own first."""
    return reduce(DataFrame.unionByName, [frame.select("sha256").distinct() for frame in referrers]).distinct()


def orphan_blobs(blobs: DataFrame, *referrers: DataFrame) -> DataFrame:
    return blobs.join(referenced_hashes(*referrers), "sha256", "left_anti")


def blob_path(sha256):
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), sha256)


def verify_archive(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Problems between a manifest and the files found: (path, problem)."""
    paired = manifest.select("path", F.col("sha256").alias("_want"), F.col("size").alias("_want_size"), F.lit(True).alias("_listed")).join(
        actual.select("path", F.col("sha256").alias("_have"), F.col("size").alias("_have_size"), F.lit(True).alias("_found")), "path", "full"
    )
    problem = (
        F.when(F.col("_found").isNull(), F.lit("missing"))
        .when(F.col("_listed").isNull(), F.lit("unexpected"))
        .when(F.col("_want_size").isNotNull() & (F.col("_want_size") != F.col("_have_size")), F.lit("size"))
        .when(F.col("_want").isNotNull() & (~F.col("_want").rlike("^[a-f0-9]{64}$") | (F.col("_want") != F.col("_have"))), F.lit("hash"))
    )
    return paired.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())


def foreign_key_violations(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(constraint, violations): one row; keys are made distinct before they meet the parents."""
    counted = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows"))
    missing = counted.join(parents.select(F.col(parent_key).alias("_key")), "_key", "left_anti")
    return missing.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def duplicate_keys(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > 1)
    return repeated.agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def null_violations(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    missing = reduce(lambda left, right: left | right, [F.col(column).isNull() for column in columns])
    return rows.agg(F.count_if(missing).alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def audit(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def queue_counts(queues: dict[str, DataFrame], now: str) -> DataFrame:
    """(name, state, value): jobs of every queue that wait, work, or wait for a later time."""
    moment = F.lit(now).cast("timestamp_ntz")
    state = F.when(F.col("lease_until") >= moment, "working").when(F.col("available_at") > moment, "later").otherwise("waiting")
    return reduce(DataFrame.unionByName, [queue.groupBy(state.alias("state")).agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "state", "value") for name, queue in queues.items()])


def statistics(counted: dict[str, DataFrame], blobs: DataFrame) -> DataFrame:
    """(name, value): row counts of named frames, and number and bytes of blobs."""
    rows = [frame.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value") for name, frame in counted.items()]
    totals = blobs.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))
    rows.append(totals.select(F.inline(F.array(F.struct(F.lit("blob_count").alias("name"), F.col("n").alias("value")), F.struct(F.lit("blob_bytes").alias("name"), F.col("bytes").alias("value"))))))
    return audit(*rows)
