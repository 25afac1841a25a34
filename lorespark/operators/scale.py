"""Building blocks that stay safe when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def latest_per(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """First row per key. Spark prunes to one row per key before and after the shuffle."""
    keys = [key] if isinstance(key, str) else key
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, group: str | list[str], limit: int, *order: Column, rank: str = "rank") -> DataFrame:
    """Best `limit` rows per group with their 1-based rank; partial top-k runs before the shuffle."""
    groups = [group] if isinstance(group, str) else group
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= limit)


def number_within(df: DataFrame, key: str, order: str, span: int = 1_000_000, name: str = "number") -> DataFrame:
    """Row number per key in order of an integer column.

    Rows are numbered inside (key, order // span) and shifted by the number of
    earlier rows of the key, so no task ever sees more than `span` rows of one key.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / span))
    counts = bucketed.groupBy(key, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inner = bucketed.withColumn("_inner", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order)))
    joined = inner.join(offsets, [key, "_bucket"])
    return joined.withColumn(name, F.col("_inner") + F.col("_offset")).drop("_bucket", "_inner", "_offset")


def count_before(points: DataFrame, marks: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """Marks with the number of points of the same key at a smaller place.

    Both are numbered together and the marks once more alone; the difference is
    the count. Neither side is multiplied, whatever a key holds.
    """
    both = points.select(key, (F.col(at) * 2 + 1).alias("_place"), F.lit(False).alias("_mark")).unionByName(marks.select(key, (F.col(at) * 2).alias("_place"), F.lit(True).alias("_mark")))
    together = number_within(both, key, "_place", 2_000_000, "_together").filter("_mark").select(key, "_place", "_together")
    alone = number_within(marks.withColumn("_place", F.col(at) * 2), key, "_place", 2_000_000, "_alone")
    return alone.join(together, [key, "_place"]).withColumn(name, F.col("_together") - F.col("_alone")).drop("_place", "_together", "_alone")


def previous_within(df: DataFrame, key: str, bucket: Column, order: list[str], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Values of the previous row of the same key.

    `bucket` must grow with `order`. Rows look back inside (key, bucket); only
    the first row of a bucket takes the last row of the bucket before.
    """
    value = F.struct(*[F.col(name) for name in columns])
    position = F.struct(*[F.col(name) for name in order])
    bucketed = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    looked = bucketed.withColumn("_inside", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = bucketed.groupBy(key, "_bucket").agg(F.max(F.struct(position.alias("position"), value.alias("value"))).alias("_last"))
    carried = last.select(
        key, "_bucket", F.lag(F.col("_last.value")).over(Window.partitionBy(key).orderBy("_bucket")).alias("_carried"), F.lit(True).alias("_first")
    )
    joined = looked.join(carried, [key, "_bucket", "_first"], "left")
    chosen = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inside"))
    return joined.select(*df.columns, *[chosen[name].alias(prefix + name) for name in columns])


def sum_before(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Rows with the sum of `value` over the earlier rows of the same key.

    Rows are dealt by ranges of (key, order), so a key with many rows lies in
    several partitions; each adds up its own, and whole partitions are added as one.
    """
    ranged = written(df.repartitionByRange(key, *order).withColumn("_bucket", F.spark_partition_id()))
    offsets = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum")).select(key, "_bucket", F.coalesce(F.sum("_sum").over(offsets), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return inner.join(sums, [key, "_bucket"]).withColumn(name, F.col("_inner") + F.col("_offset")).drop("_bucket", "_inner", "_offset")


def one_row(df: DataFrame) -> Column:
    """Columns of a one-row aggregate as a scalar subquery: no join and no driver round trip."""
    return df.select(F.struct(*[F.col(name) for name in df.columns]).alias("row")).scalar()
