"""Exact top-k inner products over norm-sorted vectors with rotated partial sums.

Vectors become integers, floor(scale * x). The eigenvectors of the summed outer
products (a matrix of bounded size, added up in Spark) rotate them so that the
leading coordinates hold most of their length. Partitions are sorted by descending
length, and a task carries the best scores of every query through all its vectors:
where length times length cannot reach a query's k-th best score so far, a vector
is skipped for that query, and so are all shorter ones; else the leading partial
sum plus the product of the residual lengths (Cauchy-Schwarz) must reach it, and
only then the exact integer product is formed. The first bound comes from the
longest vectors of the whole table.

Queries are a stated set of rows. They are processed in blocks of at most
`block_bytes` of vectors, one block after the other; each block meets all rows.

Products are exact: in 64 bits where the lengths prove that they fit, else in
Python's integers. A score that a long can't hold raises ArithmeticError.

Defined cases: a vector that is null, empty, or holds null or non-finite
components takes no part; all others do, up to 2**500 after scaling, beyond which an
error is raised; a missing last component counts as zero; rows without an id take no
part; an id that comes twice is one row for the result, with its best score, asks
with its least vector, and is no candidate of a query of that id; ties go to the
smaller id; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.arrays import bounded_batches
from lorespark.session import written

#: Scaled components beyond this are refused: squares of lengths must stay finite.
LARGEST = 2.0**500
#: Dimensions beyond this are refused: the rotation holds their square.
MAX_DIMENSIONS = 4096
#: Longest vectors of the table that give the first bounds.
HEAD = 2048
#: Rows that are bounded together.
ROWS = 512
#: Stands for a score below all longs.
_TOO_LOW = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """`id` and `v`, the integer components as doubles (which hold them exactly), of the rows that take part."""

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < 2.0**52, F.floor(F.when(F.abs(scaled) < 2.0**52, scaled)).cast("double")).when(F.abs(scaled) < LARGEST, scaled).otherwise(F.raise_error(F.lit("a component of a vector is too large")).cast("double"))

    usable = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), whole).alias("v"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Lists as rows of one matrix, short ones filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dimensions).all():
        return flat.reshape(-1, dimensions)
    out = np.zeros((len(sizes), dimensions))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different ids of each query, in order of query and rank."""
    order = np.lexsort((ids, -scores, queries))
    # An id that comes again for the same query counts once, at its best.
    _, once = np.unique(np.stack([queries[order], ids[order]]), axis=1, return_index=True)
    order = order[np.sort(once)]
    owner = queries[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    return order[rank < k]


def products(left: np.ndarray, right: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of rows; `bounds` are products of their lengths."""
    scores = np.empty(len(left), np.int64)
    small = bounds < 2.0**62
    # A row that holds a larger number than 64 bits has a length beyond the bound, unless the other is zero.
    scores[small] = np.einsum("ij,ij->i", np.clip(left[small], -(2.0**62), 2.0**62).astype(np.int64), np.clip(right[small], -(2.0**62), 2.0**62).astype(np.int64))
    for at in np.flatnonzero(~small).tolist():
        score = sum(int(a) * int(b) for a, b in zip(left[at].tolist(), right[at].tolist()) if a and b)
        if score >= 1 << 63:
            raise ArithmeticError("a score does not fit 64 bits")
        scores[at] = max(score, _TOO_LOW)
    return scores


@dataclass(frozen=True)
class QueryBlock:
    """Queries with their rotation and what their k-th best score is known to reach."""

    ids: np.ndarray
    vectors: np.ndarray
    rotation: np.ndarray
    leading: int
    k: int
    floors: np.ndarray


class Scan:
    """The k best of all rows that are given, batch by batch; the bounds go on from batch to batch."""

    def __init__(self, block: QueryBlock) -> None:
        self.block = block
        rotated = block.vectors @ block.rotation
        self.lead, self.rest = rotated[:, : block.leading], np.linalg.norm(rotated[:, block.leading :], axis=1)
        self.norms = np.linalg.norm(rotated, axis=1)
        # A bound may miss the true product by rounding only.
        self.slack = 1e-9 * np.maximum(self.norms, 1)
        self.floors = block.floors.copy()
        #: query places, ids, scores
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        block = self.block
        norms = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-norms, kind="stable")
        for start in range(0, len(order), ROWS):
            rows = order[start : start + ROWS]
            alive = np.flatnonzero(self.norms * norms[rows[0]] + self.slack * norms[rows[0]] + 1 >= self.floors)
            if not len(alive):
                return
            rotated = vectors[rows] @ block.rotation
            bound = self.lead[alive] @ rotated[:, : block.leading].T
            bound += np.outer(self.rest[alive], np.linalg.norm(rotated[:, block.leading :], axis=1))
            bound += np.outer(self.slack[alive], norms[rows]) + 1e-6
            at, row = np.nonzero(bound >= self.floors[alive, None])
            at, row = alive[at], rows[row]
            other = block.ids[at] != ids[row]
            at, row = at[other], row[other]
            if not len(at):
                continue
            parts = [slice(part, part + (1 << 16)) for part in range(0, len(at), 1 << 16)]
            scores = np.concatenate([products(block.vectors[at[some]], vectors[row[some]], self.norms[at[some]] * norms[row[some]] * (1 + 1e-9)) for some in parts])
            joined = [np.concatenate(pair) for pair in zip(self.best, (at, ids[row], scores))]
            chosen = best_of(*joined, block.k)
            self.best = tuple(column[chosen] for column in joined)
            self.floors = np.maximum(self.floors, self.reached())

    def reached(self) -> np.ndarray:
        """The k-th best score of each query that has as many."""
        places, _, scores = self.best
        lowest = np.full(len(self.block.ids), np.iinfo(np.int64).max)
        np.minimum.at(lowest, places, scores)
        return np.where(np.bincount(places, minlength=len(lowest)) == self.block.k, lowest.astype(np.float64), -np.inf)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = 16 << 20) -> DataFrame:
    """`query_id`, `rank`, `vec_id` and `score`: the k best other rows of every row for which `is_query` holds."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    asked = integer_vectors(vectors.filter(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    dimensions, query_count = rows.select(F.max(F.size("v"))).first()[0], asked.select("id").count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dimensions or not query_count:
        return empty
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} dimensions")

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            part = matrix(batch.column(0), dimensions)
            total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "cells"])

    cells = rows.select("v").mapInArrow(outer, "row long, cells array<double>").select("row", F.posexplode("cells").alias("column", "cell"))
    summed = cells.groupBy("row", "column").agg(F.sum("cell").alias("cell")).toArrow()
    gram = np.zeros((dimensions, dimensions))
    gram[summed["row"].to_numpy(), summed["column"].to_numpy()] = summed["cell"].to_numpy()
    values, rotation = np.linalg.eigh(gram / (np.abs(gram).max() or 1.0))
    values, rotation = values[::-1], rotation[:, ::-1].copy()
    energy = np.cumsum(np.maximum(values, 0))
    # Leading coordinates: as many as hold 80 % of the squared length.
    leading = int(np.searchsorted(energy, 0.8 * energy[-1]) + 1) if energy[-1] > 0 else 1

    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    head = rows.withColumn("_length", length).orderBy(F.col("_length").desc(), "id").limit(HEAD).select("id", "v").toArrow().combine_chunks()
    head_ids, head_vectors = head["id"].to_numpy(), matrix(head["v"].combine_chunks(), dimensions)
    ordered = rows.withColumn("_length", length).sortWithinPartitions(F.col("_length").desc()).select("id", "v")
    blocks = -(-query_count * dimensions * 8 // block_bytes)
    if blocks > 1:  # several scans: sorted once
        ordered, asked = written(ordered), written(asked)
    found = []
    for number in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)
        table = part.toArrow().combine_chunks()
        if not len(table):
            continue
        none = np.full(len(table), -np.inf)
        first = Scan(QueryBlock(table["id"].to_numpy(), matrix(table["v"].combine_chunks(), dimensions), rotation, leading, k, none))
        first.add(head_ids, head_vectors)
        shipped = spark.sparkContext.broadcast(replace(first.block, floors=first.floors))

        def work(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            scan = Scan(shipped.value)
            for batch in batches:
                scan.add(batch.column(0).to_numpy(), matrix(batch.column(1), dimensions))
            places, ids, scores = scan.best
            yield pa.RecordBatch.from_arrays([pa.array(scan.block.ids[places]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        partial = ordered.mapInArrow(work, "query_id long, vec_id long, score long")
        once = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)
        found.append(ranked if blocks == 1 else written(ranked))  # one block after the other
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    score = F.when(F.col("score") > _TOO_LOW, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return out.select("query_id", "rank", "vec_id", score.alias("score"))
