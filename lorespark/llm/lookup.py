"""Rows of a large table by a set of ids, and connected components, without moving what is not needed.

The set of ids becomes a bitmap of fixed size (FILTER_BITS), which is broadcast
and lets most other rows fall away in the scan, before any shuffle. It may let
some pass that are not in the set, so an exact join always follows; where the
set is too large for the bitmap, the join just sees more rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.session import own_shuffles, release, ship, written

#: 2 MB to broadcast, whatever the set holds.
FILTER_BITS = 1 << 24


#: The same for sets of 64-bit hashes, by their low bits: 8 MB.
KEY_BITS = 1 << 26


def _words(places: DataFrame) -> pa.Table:
    """Places of bits as words of 64 bits."""
    with own_shuffles(places.sparkSession):
        return places.groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a set of hashes, put together in Spark."""
    place = keys.select(F.expr(f"{column} & {KEY_BITS - 1}L").alias("place"))
    words = _words(place)
    bitmap = np.zeros(KEY_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in the set of a `key_bitmap`."""
    place = keys & np.uint64(KEY_BITS - 1)
    return (bitmap.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) == 1


def _place(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def id_bitmap(ids: DataFrame, id_col: str) -> np.ndarray:
    """The bitmap of a set of ids, put together in Spark."""
    place = ids.filter(F.col(id_col).isNotNull()).select(_place(F.col(id_col)).alias("place"))
    words = _words(place)
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap


def with_place(rows: DataFrame, id_col: str) -> DataFrame:
    """`rows` with the place of their id in a bitmap as one more column, the last; what `row_filter` takes."""
    return rows.select(*[F.col(f"`{name}`") for name in rows.columns], F.when(F.col(id_col).isNotNull(), _place(F.col(id_col))).alias("_place_of_id"))


def row_filter(rows: DataFrame, bitmap: np.ndarray, inside: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step for mapInArrow over `with_place(rows)`; it can be followed by another step in the same worker."""
    held = ship(rows.sparkSession, bitmap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value.view(np.uint64)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            place = column.fill_null(0).to_numpy(zero_copy_only=False)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            hit = known & ((bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)) == 1)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(hit if inside else ~hit))

    return work


def filter_rows(rows: DataFrame, bitmap: np.ndarray, id_col: str, inside: bool = True) -> DataFrame:
    """Rows whose id may be in the set, or with `inside=False` those whose id is certainly not (null ids are not)."""
    return with_place(rows, id_col).mapInArrow(row_filter(rows, bitmap, inside), rows.schema)


def merged(side: DataFrame) -> DataFrame:
    """`side` of a join that is shuffled, however small: for a join between two Python steps.

    A broadcast would leave both steps in one task, which then holds two workers at
    a time. An executor takes its idle workers in turn and ends none while it is
    busy, so from then on twice as many would stay, each with the model of its step.
    """
    return side.hint("merge")


def rows_with(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is in `ids` (one column of the same name, without repeats)."""
    return filter_rows(rows, id_bitmap(ids, id_col), id_col).join(ids, id_col, "left_semi")


def rows_without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not in `ids`; a null id is in no set. Only the doubtful rows are shuffled."""
    bitmap = id_bitmap(ids, id_col)
    doubtful = filter_rows(rows, bitmap, id_col).join(ids, id_col, "left_anti").select(*rows.columns)
    return filter_rows(rows, bitmap, id_col, inside=False).unionByName(doubtful)


def components(edges: DataFrame) -> DataFrame:
    """`node` and `label` (least node reachable) of all nodes of `edges` (columns a, b of one type that can be ordered).

    Labels sink along edges; a smaller label also goes to the node that was the
    label so far, and labels of labels are taken over, so long chains shrink by
    half a round. Each round is a written table; only the last one stays.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    held = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("changed", F.lit(True)))
    while True:
        labels = held.drop("changed")
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        offers = lower.select("node", "new").unionByName(lower.filter("new < label").select(F.col("label").alias("node"), "new")).groupBy("node").agg(F.min("new").alias("new"))
        above = offers.select(F.col("node").alias("new"), F.col("new").alias("above"))
        after = written(labels.join(offers, "node").join(above, "new", "left").select("node", F.coalesce("above", "new").alias("label"), (F.coalesce("above", "new") != F.col("label")).alias("changed")))
        release(held)
        held = after
        if after.filter("changed").isEmpty():
            release(both)
            return after.drop("changed")
