"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a quantile.

Every labelled good document is preferred to some labelled bad ones. The strength
of a document is a linear function of features of its whole text; logistic loss on
the strength differences of the pairs gives the weights. A pair's gradient is a
multiple of the feature difference, so the pairs only add up to one coefficient a
document, and differences are never stored.

All labelled rows take part. They are dealt by the hashes of their ids into groups
of some `rows_per_label` rows of a label, in which they meet; rows of a rare label
stand in several groups. The features of a group are computed once and written as
one block. Newton steps then go over all blocks, each task adding up the gradient
and the curvature of its own, until the likelihood of all pairs is at its only
optimum; that the first step starts from the optimum of one block saves passes and
does not change where they end.

The cut is the quantile of the strengths below which the labelled bad documents
belong by their share. A score is the chance of the document to win against one at
the cut, moved so that the cut has the score `cut_score`.

Features: shares of hashed pairs of neighbouring bytes (letters with, and classes
without, their case), and word statistics (length, repetition, capitals, signs).
Neither ids nor any other column takes part.

The cut is the exact quantile over all labelled rows, to 2**-30. Scoring covers all
rows and whole texts.

Defined cases: a null text is an empty text, which has a score like any other
(all its features are zero); a label that is null is none, positive labels are
good; an id with several labels is several rows; rows without an id are scored but
not learned from; without labelled rows of both kinds every score is one half;
repeated rows are kept one to one; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrays import SPACED, bounded_batches, byte_values, class_table, drop_model, mix, range_hashes, text_slices, word_spans
from lorespark.llm.lookup import id_bitmap, row_filter, with_place
from lorespark.session import release, written

#: Buckets of the byte pairs.
BUCKETS = 1024
_STATISTICS = 10
FEATURES = BUCKETS + _STATISTICS
#: Bytes that are counted together when single texts are longer: bounds the temporary arrays.
PIECE = 1 << 20

#: Byte to class: letters a, A, other character x, digit 0, blank, line end, signs as they are.
_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[ord("a") : ord("z") + 1] = ord("a")
_CLASSES[ord("A") : ord("Z") + 1] = ord("A")
_CLASSES[ord("0") : ord("9") + 1] = ord("0")
_CLASSES[0x80:] = ord("x")
_MAPPED = class_table(SPACED, lower=False)
#: Rows of the rarer label that a group is dealt on average, if there are so many.
_FEWEST = 64
#: Strengths are ranked in steps of its inverse, by counting so many bins at a time.
_SCALE, _BINS = 1 << 30, 1 << 12
_CODEC = "zstd"


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    center: np.ndarray
    cut: float
    cut_score: float


def _pairs(codes: np.ndarray, owners: np.ndarray, counts: np.ndarray, salt: int) -> None:
    """Add the pairs of neighbours that belong to one row."""
    joined = codes[:-1].astype(np.uint64) << np.uint64(8) | codes[1:]
    same = owners[:-1] == owners[1:]
    bucket = (mix(joined[same] + np.uint64(salt)) >> np.uint64(64 - 9)).astype(np.int64) + (BUCKETS // 2 if salt > 1 << 16 else 0)
    counts += np.bincount(owners[:-1][same] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros((rows, BUCKETS), np.int64)
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + 1]  # one byte of the next piece closes the last pair
        owners = np.searchsorted(offsets, np.arange(at, at + len(part)), "right") - 1
        _pairs(part, owners, counts, 0)
        _pairs(_CLASSES[part], owners, counts, 1 << 17)
    out = np.zeros((rows, FEATURES))
    pairs = np.maximum(sizes - 1, 1)[:, None]
    out[:, :BUCKETS] = np.sqrt(counts / pairs)

    starts, ends, bounds = word_spans(_MAPPED[data], offsets)
    words = np.diff(bounds)
    owner = np.repeat(np.arange(rows), words)
    n = np.maximum(words, 1)
    hashes = range_hashes(byte_values(data), starts, ends) if len(starts) else np.empty(0, np.uint64)
    lengths = ends - starts
    per_row = lambda values: np.bincount(owner, values, rows) / n
    again = np.zeros(len(starts), np.bool_)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    first = np.ones(len(order), np.bool_)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(first), len(order)))
    most = np.zeros(rows)
    np.maximum.at(most, owner[order][first], runs)
    upper = np.cumsum(np.append(0, (data >= 65) & (data <= 90)))
    signs = np.cumsum(np.append(0, (data < 0x80) & (data > 0x20) & ~((data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122))))
    out[:, BUCKETS:] = np.stack(
        [
            np.log1p(words) / 10,
            per_row(lengths) / 10,
            np.sqrt(per_row(lengths.astype(np.float64) ** 2)) / 10,
            np.sqrt(per_row(again)),
            np.bincount(owner[order][first], minlength=rows) / n,
            np.sqrt(most / n),
            np.sqrt(per_row(upper[ends] - upper[starts] == lengths)),
            np.sqrt(per_row((upper[ends] - upper[starts]) / np.maximum(lengths, 1))),
            np.sqrt(per_row((signs[ends] - signs[starts]) / np.maximum(lengths, 1))),
            np.sqrt(per_row(signs[ends] - signs[starts] == lengths)),
        ],
        axis=1,
    )
    return out


def preferences(good: np.ndarray, bad: np.ndarray, opponents: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (preferred, other): every document meets at least `opponents` of the other kind, or all of them."""
    many = max(len(good), len(bad))
    each = min(opponents, min(len(good), len(bad)))
    place, turn = np.tile(np.arange(many), each), np.repeat(np.arange(each), many)
    return good[(place + (turn if many > len(good) else 0)) % len(good)], bad[(place + (turn if many <= len(good) else 0)) % len(bad)]


def strengths(rows: np.ndarray, preferred: np.ndarray, other: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights that maximise the likelihood of the preferences less a quadratic penalty: accelerated gradient steps."""
    pairs = len(preferred)
    # The curvature is at most a quarter of that of the mean squared difference.
    probe = np.ones(rows.shape[1]) / np.sqrt(rows.shape[1])
    top = 1.0
    for _ in range(30):
        gap = (rows @ probe)[preferred] - (rows @ probe)[other]
        back = np.bincount(preferred, gap, len(rows)) - np.bincount(other, gap, len(rows))
        probe = back @ rows / pairs
        top = float(np.linalg.norm(probe))
        probe /= top or 1.0
    step = 1 / (top / 4 * 1.05 + penalty)
    weights, ahead, momentum = np.zeros(rows.shape[1]), np.zeros(rows.shape[1]), 1.0
    for _ in range(rounds):
        values = rows @ ahead
        lost = 0.5 - 0.5 * np.tanh((values[preferred] - values[other]) / 2)  # 1 - chance of the preferred one
        share = np.bincount(preferred, lost, len(rows)) - np.bincount(other, lost, len(rows))
        after = ahead + step * (share @ rows / pairs - penalty * ahead)
        next_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = after + (momentum - 1) / next_momentum * (after - weights)
        weights, momentum = after, next_momentum
    return weights


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The middle between the last value within `share` of the weight and the next one."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order]) / weights.sum()
    last = int(np.searchsorted(upto, share * (1 + 1e-9), "right")) - 1
    return float((values[order[max(last, 0)]] + values[order[min(last + 1, len(values) - 1)]]) / 2)


def slopes(rows: np.ndarray, good: int, weights: np.ndarray, opponents: int) -> tuple[float, int, np.ndarray, np.ndarray]:
    """Loss, number, gradient and curvature of the pairs of one group, whose first `good` rows are the good ones."""
    preferred, other = preferences(np.arange(good), np.arange(good, len(rows)), opponents)
    values = rows @ weights
    gap = values[preferred] - values[other]
    lost = 0.5 - 0.5 * np.tanh(gap / 2)  # 1 - chance of the preferred one
    share = np.bincount(preferred, lost, len(rows)) - np.bincount(other, lost, len(rows))
    curved = (lost * (1 - lost)).astype(np.float32)
    degree = np.bincount(preferred, curved, len(rows)) + np.bincount(other, curved, len(rows))
    moved = degree.astype(np.float32)[:, None] * rows
    fewer, many = min(good, len(rows) - good), max(good, len(rows) - good)
    for at in range(0, len(preferred), many):
        for first in range(at, at + many, fewer):  # no row twice on either side
            part = slice(first, min(first + fewer, at + many))
            one, two, weight = preferred[part], other[part], curved[part, None]
            moved[one] -= weight * rows[two]
            moved[two] -= weight * rows[one]
    return float(np.logaddexp(0, -gap).sum()), len(preferred), -share @ rows, moved.T @ rows


def _blocks(texts: DataFrame, known: DataFrame, groups: int, rare: bool, copies: int) -> DataFrame:
    """(group, good, size, rows): the features of each group, good rows first.

    A bitmap of the labelled ids lets most other texts fall away in the scan; texts are never shuffled, their features are.
    """
    labelled = row_filter(texts, id_bitmap(known, "_labelled"), True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in labelled(batches):
            for first, data, offsets in text_slices(batch.column(1)):
                values = features(data, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(values)), pa.array([row.tobytes() for row in values], pa.binary())], ["id", "features"])

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """An id that the documents repeat counts once, with the least of its features."""
        order = table.sort_by([("good", "descending"), ("id", "ascending"), ("features", "ascending")])
        ids, good, rows = order["id"].to_pylist(), order["good"].to_pylist(), order["features"].to_pylist()
        kept = [at for at in range(len(ids)) if not at or (ids[at], good[at]) != (ids[at - 1], good[at - 1])]
        packed = pa.compress(b"".join(rows[at] for at in kept), _CODEC, asbytes=True)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(good[at] for at in kept)], pa.int32()), pa.array([len(kept)], pa.int32()), pa.array([packed], pa.binary())], ["group", "good", "size", "rows"])

    single = with_place(texts, "_labelled").mapInArrow(work, "id string, features binary")
    own = F.pmod(F.xxhash64(F.lit("quality group"), "id"), F.lit(groups)).cast("int")
    several = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda more: F.pmod(own + more, F.lit(groups)))
    dealt = single.join(known.select(F.col("_labelled").alias("id"), F.col("_good").alias("good")), "id")
    grouped = dealt.select(F.explode(F.when(F.col("good") == rare, several).otherwise(F.array(own))).alias("group"), "id", "good", "features").groupBy("group")
    return grouped.applyInArrow(pack, "group int, good int, size int, rows binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for good, size, rows in zip(batch["good"].to_pylist(), batch["size"].to_pylist(), batch["rows"]):
            yield good, np.frombuffer(pa.decompress(rows.as_buffer(), size * FEATURES * 4, _CODEC), np.float32).reshape(size, FEATURES)


def _sums(blocks: DataFrame, weights: np.ndarray, opponents: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss, its gradient and curvature over the pairs of all groups; sums of the features and numbers of rows by label."""

    def add_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        total = np.zeros((FEATURES + 4, FEATURES))
        for good, rows in _opened(batches):
            total[FEATURES] += rows[:good].sum(axis=0, dtype=np.float64)
            total[FEATURES + 1] += rows[good:].sum(axis=0, dtype=np.float64)
            total[FEATURES + 3, 2:4] += good, len(rows) - good
            if 0 < good < len(rows):
                loss, pairs, gradient, curvature = slopes(rows, good, weights, opponents)
                total[:FEATURES] += curvature
                total[FEATURES + 2] += gradient
                total[FEATURES + 3, :2] += loss, pairs
        if total[FEATURES + 3, 2:4].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["line", "sums"])

    def add_tasks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"line": table["line"][:1], "sums": pa.array([np.sum([line.values.to_numpy() for line in table["sums"]], axis=0)], pa.list_(pa.float64()))})

    schema = "line int, sums array<double>"
    found = blocks.mapInArrow(add_groups, schema).groupBy("line").applyInArrow(add_tasks, schema).orderBy("line").toArrow().combine_chunks()
    total = np.zeros((FEATURES + 4, FEATURES)) if not len(found) else np.concatenate([chunk.flatten().to_numpy() for chunk in found["sums"].chunks]).reshape(FEATURES + 4, FEATURES)
    loss, pairs, *counts = total[-1, :4]
    pairs = max(pairs, 1)
    curvature = (total[:FEATURES] + total[:FEATURES].T) / 2 / pairs
    return loss / pairs, total[FEATURES + 2] / pairs, curvature, total[FEATURES : FEATURES + 2], np.array(counts)


def _at_rank(scaled: DataFrame, low: int, high: int, rank: int) -> int:
    """The value (from `low` to `high`) that `rank` values come before in order: bins are counted, and the one that holds it is split again."""
    while low < high:
        width = (high - low) // _BINS + 1
        counts = scaled.filter(F.col("value").between(low, high)).groupBy(F.expr(f"(value - {low}L) div {width}L").alias("bin")).agg(F.sum("weight").alias("rows")).collect()
        for row in sorted(counts):
            if rank < row.rows:
                break
            rank -= row.rows
        low, high = low + row.bin * width, min(high, low + (row.bin + 1) * width - 1)
    return low


def middle_at(measured: DataFrame, below: int) -> float:
    """The middle between the last `strength` within `below` of the `weight` and the next one, in order and to 2**-30."""
    scaled = measured.select(F.round(F.col("strength") * _SCALE).cast("bigint").alias("value"), "weight")
    ends = scaled.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    return (_at_rank(scaled, ends.low, ends.high, below - 1) + _at_rank(scaled, ends.low, ends.high, below)) / 2 / _SCALE


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows_per_label: int = 3000,
    opponents: int = 12,
    penalty: float = 1e-4,
    rounds: int = 400,
    cut_score: float = 0.7,
) -> QualityModel:
    """Learn from all rows of `labels` for which `learn`, a column over their ids, holds; groups have some `rows_per_label` rows of a label."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.coalesce(learn, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("_labelled"), (F.col(label_col) > 0).alias("_good"))
    shares = {row._good: row.n for row in known.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    center = np.zeros(FEATURES)
    nothing = QualityModel(np.zeros(FEATURES), center, 0.0, 0.5)
    if len(shares) < 2:
        return nothing
    groups = -(-max(shares.values()) // rows_per_label)
    # Groups are dealt by hashes: where a label is rare, its rows stand in so many groups that none goes without.
    rare = shares[True] < shares[False]
    copies = min(groups, -(-_FEWEST * groups // min(shares.values())))
    texts = docs.select(F.col(id_col).cast("string").alias("_labelled"), F.col(text_col).cast("string").alias("_text"))
    blocks = written(_blocks(texts, known, groups, rare, copies))

    weights, best, lowest = np.zeros(FEATURES), None, np.inf
    for good, rows in _opened(blocks.filter("group = 0").toArrow().to_batches()):
        if 0 < good < len(rows):
            weights = strengths(rows - rows.mean(axis=0, dtype=np.float64), *preferences(np.arange(good), np.arange(good, len(rows)), opponents), penalty, rounds)
    for _ in range(rounds):
        loss, gradient, curvature, sums, counts = _sums(blocks, weights, opponents)
        if not counts.all():
            release(blocks)
            return nothing
        loss += penalty / 2 * weights @ weights
        if loss > lowest * (1 + 1e-9):  # a step too far
            weights = (weights + best) / 2
            continue
        best, lowest = weights, loss
        gradient += penalty * weights
        step = -np.linalg.solve(curvature + penalty * np.eye(FEATURES), gradient)
        weights = weights + step
        if -gradient @ step < 1e-12:
            break
    else:
        raise RuntimeError(f"the likelihood has not come to its optimum in {rounds} rounds")
    center = (sums[0] / counts[0] + sums[1] / counts[1]) / 2

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for good, rows in _opened(batches):
            often = np.where((np.arange(len(rows)) < good) == rare, 1, copies)  # rows of the rare label come `copies` times
            yield pa.RecordBatch.from_arrays([pa.array((rows - center) @ weights), pa.array(often)], ["strength", "weight"])

    measured = written(blocks.mapInArrow(measure, "strength double, weight bigint"))
    cut = middle_at(measured, int(counts[1]) * (1 if not rare else copies))
    release(blocks, measured)
    return QualityModel(weights, center, cut, cut_score)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `strength` and `score` (0 to 1) of every row."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        own: QualityModel = shipped.value
        moved = np.log(own.cut_score / (1 - own.cut_score)) - own.cut
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                rows = len(offsets) - 1
                strength = ((features(data, offsets) - own.center) * own.weights).sum(axis=1)
                chance = 0.5 + 0.5 * np.tanh((strength + moved) / 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(strength), pa.array(chance)], ["_id", "strength", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(work, f"_id {kind}, strength double, score double")
    return scored.select(F.col("_id").alias(id_col), "strength", "score")


def above(scored: DataFrame, limit: float = 0.7) -> DataFrame:
    """Scored rows with `predicted`: 1 from the limit on, else 0."""
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))
