"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents become sets of hashed word shingles. Equal sets are one class, so
copies are never compared. All sets are ordered alike, by estimated frequency
and hash. Of a set of n, any partner shares at least t = ceil(threshold * n)
tokens, so among its first n - t + l tokens it shares l with every partner. Each
set picks its own l: a longer prefix reads longer lists but asks for more
matches; the estimate of both decides. Two sets are candidates when they share
as many prefix tokens as the smaller of their two demands.

Only the classes are linked that must be to know all components. First every
token offers its rows to two of them (linear in the token's rows); pairs that
hold are joined into components. Then all candidate pairs between different
components are made, so no link that matters is lost. Candidates meet a parity
bitmap first: sets differ in at least as many tokens as their bitmaps differ in
bits, which proves most false candidates wrong; what is left is decided on the
shingles of the texts themselves.

Frequencies come from counters of fixed number over all documents; they steer
the order and the choice of l and never the result.

Defined cases: a text with fewer words than a shingle is one shingle of all its
words; a null text or one without words is the empty set, linked with nothing; a
row without an id has its set counted and no component; rows are kept one to one,
and rows with equal ids are linked by their own texts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrays import SPACED, bounded_batches, byte_values, class_table, drop_model, mix, range_hashes, text_slices, word_spans
from lorespark.llm.lookup import components, id_bitmap, key_bitmap, marked, merged, row_filter, rows_without, with_place
from lorespark.session import recorded, release, ship, written

_TABLE = class_table(SPACED, lower=True)
COUNTER_BITS = 18
MAX_MATCHES = 4
#: Checking a candidate costs as much as reading so many list entries.
CHECK_COST = 8
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a slice."""
    mapped = _TABLE[data]
    starts, ends, bounds = word_spans(mapped, offsets)
    words = range_hashes(byte_values(mapped), starts, ends)
    count = np.diff(bounds)
    grams = np.maximum(count - size + 1, np.minimum(count, 1))
    begin = np.repeat(bounds[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    hashes = range_hashes(words, begin, begin + np.repeat(np.minimum(count, size), grams))
    after = np.cumsum(grams)
    for first, last in zip((after - grams).tolist(), after.tolist()):
        own = np.sort(hashes[first:last])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def digest_of(tokens: np.ndarray) -> int:
    """One number for a set."""
    return int(np.bitwise_xor.reduce(mix(tokens)) ^ np.sum(mix(tokens ^ _SECOND)))


def parity_bits(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each bit; about twice as many bits as tokens."""
    bits = 1 << max(6, min(20, int(2 * len(tokens) - 1).bit_length()))
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing_bits(one: bytes, other: bytes) -> int:
    """Bits in which two parity bitmaps differ; the longer one is folded."""
    left, right = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    while len(left) > len(right):
        left = left[: len(left) // 2] ^ left[len(left) // 2 :]
    while len(right) > len(left):
        right = right[: len(right) // 2] ^ right[len(right) // 2 :]
    return int(np.bitwise_count(left ^ right).sum())


def chosen_prefix(tokens: np.ndarray, others: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(prefix, matches it asks for) of a sorted set; `others` estimates how many more sets hold a counter's tokens."""
    n = len(tokens)
    shared = (percent * n + 99) // 100
    estimate = others[(tokens >> np.uint64(65 - len(others).bit_length())).astype(np.int64)]
    if not estimate.any():
        return tokens[: n - shared + 1], 1
    order = np.lexsort((tokens, estimate))
    sums = np.cumsum(estimate[order])
    best, matches = None, 1
    for wanted in range(1, min(MAX_MATCHES, shared) + 1):
        length = n - shared + wanted
        cost = length + sums[length - 1] + CHECK_COST * sums[length - 1] / wanted
        if best is None or cost < best:
            best, matches = cost, wanted
    return tokens[order[: n - shared + matches]], matches


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def signatures(docs: DataFrame, size: int, counter_bits: int) -> DataFrame:
    """Rows of documents (id, n, cls, bits) and of counters (cls = counter, n = tokens, id and bits null, is_counter)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        counters = np.zeros(1 << counter_bits, np.int64)
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                n, digests, bits = [], [], []
                for tokens in shingle_sets(data, offsets, size):
                    n.append(len(tokens))
                    digests.append(digest_of(tokens) if len(tokens) else 0)
                    bits.append(parity_bits(tokens) if len(tokens) else None)
                    np.add.at(counters, (tokens >> np.uint64(64 - counter_bits)).astype(np.int64), 1)
                rows = len(offsets) - 1
                columns = [batch.column(0).slice(first, rows), pa.array(n, pa.int64()), _signed(np.array(digests, np.uint64)), pa.array(bits, pa.binary()), pa.array([False] * rows, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names)
        seen = np.flatnonzero(counters)
        empty = [pa.nulls(len(seen), kind_of_id), pa.array(counters[seen]), pa.array(seen), pa.nulls(len(seen), pa.binary()), pa.array([True] * len(seen), pa.bool_())]
        yield pa.RecordBatch.from_arrays(empty, names)

    names = ["id", "n", "cls", "bits", "is_counter"]
    kind_of_id = pa.int64()
    return docs.mapInArrow(work, "id long, n long, cls long, bits binary, is_counter boolean")


def prefix_tokens(docs: DataFrame, others: np.ndarray, size: int, percent: int) -> DataFrame:
    """The prefix tokens of all documents, without anything else."""
    shipped = ship(docs.sparkSession, others)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(1)):
                found = [chosen_prefix(own, shipped.value, percent)[0] for own in shingle_sets(data, offsets, size) if len(own)]
                if found:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found))], ["token"])

    return docs.filter("_id is not null").mapInArrow(work, "token long")


def prefixes(docs: DataFrame, others: np.ndarray, often: np.ndarray, size: int, percent: int) -> DataFrame:
    """Prefix rows (token, cls, n, need, and the token's place in the ordered set) of all documents, for tokens that the bitmap `often` marks."""
    shipped = ship(docs.sparkSession, (others, often))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        estimate, bitmap = shipped.value
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(1)):
                tokens, places, digests, sizes, needs, times = [], [], [], [], [], []
                for own in shingle_sets(data, offsets, size):
                    if len(own):
                        prefix, need = chosen_prefix(own, estimate, percent)
                        at = np.flatnonzero(marked(bitmap, prefix))
                        tokens.append(prefix[at])
                        places.append(at)
                        digests.append(digest_of(own))
                        sizes.append(len(own))
                        needs.append(need)
                        times.append(len(at))
                if tokens:
                    columns = [_signed(np.concatenate(tokens)), _signed(np.repeat(np.array(digests, np.uint64), times)), pa.array(np.repeat(sizes, times))]
                    columns += [pa.array(np.repeat(needs, times).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["token", "cls", "n", "need", "at"])

    return docs.filter("_id is not null").mapInArrow(work, "token long, cls long, n long, need int, at int")


def not_disproved(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b: structs of n and cls) that size and bitmaps leave possible, with one document of each."""
    side = classes.select(F.struct("n", "cls").alias("key"), "rep", "bits")
    left, right = side.toDF("a", "rep_a", "bits_a"), side.toDF("b", "rep_b", "bits_b")

    joined = pairs.join(left, "a").join(right, "b")
    flat = joined.select(
        F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"), "rep_a", "rep_b", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), "bits_a", "bits_b"
    )
    return flat.mapInArrow(_tested(percent), "cls_a long, cls_b long, rep_a long, rep_b long, n_a long, n_b long").select(
        F.struct(F.col("n_a").alias("n"), F.col("cls_a").alias("cls")).alias("a"), F.struct(F.col("n_b").alias("n"), F.col("cls_b").alias("cls")).alias("b"), "rep_a", "rep_b"
    )


def _tested(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            sizes = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            differ = np.array([differing_bits(one.as_py(), other.as_py()) for one, other in zip(batch.column(6), batch.column(7))], np.int64)
            yield batch.select(range(6)).filter(pa.array((100 + percent) * differ <= (100 - percent) * sizes))

    return work


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose texts' shingle sets are as similar as asked; edges a, b."""
    pairs = written(pairs)
    needed = pairs.select(F.col("rep_a").alias("_id")).unionByName(pairs.select(F.col("rep_b").alias("_id"))).distinct()
    # A document id may come with several texts; the class tells which one is meant.
    needed_rows = row_filter(docs, id_bitmap(needed, "_id"), True)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in needed_rows(batches):
            for first, data, offsets in text_slices(batch.column(1)):
                digests, sizes = [], []
                for own in shingle_sets(data, offsets, size):
                    digests.append(digest_of(own) if len(own) else 0)
                    sizes.append(len(own))
                rows = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(sizes, pa.int64()), _signed(np.array(digests, np.uint64))], ["_id", "_text", "n", "cls"])

    keyed = with_place(docs, "_id").mapInArrow(sets, "_id long, _text string, n long, cls long")
    left = keyed.select(F.col("_id").alias("rep_a"), F.struct("n", "cls").alias("a"), F.col("_text").alias("text_a"))
    right = keyed.select(F.col("_id").alias("rep_b"), F.struct("n", "cls").alias("b"), F.col("_text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(4), batch.column(5)):
                sides = []
                for text in (one.as_py(), other.as_py()):
                    data = np.frombuffer(text.encode(), np.uint8)
                    sides.append(next(shingle_sets(data, np.array([0, len(data)]), size)))
                common = len(np.intersect1d(*sides, assume_unique=True))
                keep.append(100 * common >= percent * (len(sides[0]) + len(sides[1]) - common))
            yield batch.select(range(4)).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, ["rep_a", "a"]).join(merged(right), ["rep_b", "b"])
    flat = joined.select(F.col("a.n").alias("n_a"), F.col("a.cls").alias("cls_a"), F.col("b.n").alias("n_b"), F.col("b.cls").alias("cls_b"), "text_a", "text_b")
    held = flat.mapInArrow(compare, "n_a long, cls_a long, n_b long, cls_b long").distinct()
    return held.select(F.struct(F.col("n_a").alias("n"), F.col("cls_a").alias("cls")).alias("a"), F.struct(F.col("n_b").alias("n"), F.col("cls_b").alias("cls")).alias("b"))


def _in_reach(a: str, b: str, percent: int) -> str:
    """Sizes near enough, and enough tokens left from this one on.

    a and b have n, need and at. Similar sets share percent / (100 + percent) of
    both sizes together. One of the first `need` tokens that they share has fewer
    than `need` shared ones before it and at most the rest of either set after it.
    """
    left = f"(least({a}.n - {a}.at, {b}.n - {b}.at) + least({a}.need, {b}.need) - 1)"
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * {left} >= {percent} * ({a}.n + {b}.n)"


def _components(plain: DataFrame, others: np.ndarray, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """node (n, cls) and label of all classes that have a link."""
    # A bitmap of fixed size keeps most tokens that only one row has out of the shuffle.
    often = prefix_tokens(plain, others, size, percent).groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1")
    listed = prefixes(plain, others, key_bitmap(often, "token"), size, percent)
    node, member = F.struct("n", "cls"), F.struct("at", "n", "cls", "need")
    # The set in which a token comes first has the fewest tokens of its own: of a group of near copies it is the one most others are near to.
    several = listed.groupBy("token").agg(F.min("cls").alias("c"), F.max("cls").alias("d")).filter("c <> d").select("token")
    shared = written(listed.join(several, "token", "left_semi"))
    ends = shared.groupBy("token").agg(F.min(member).alias("least"), F.max(F.struct("cls", "n", "at", "need")).alias("most"))
    met = shared.join(ends, "token")
    offered = met.select(F.col("least").alias("x"), member.alias("y")).unionByName(met.select(F.struct("most.at", "most.n", "most.cls", "most.need").alias("x"), member.alias("y")))
    offered = offered.filter(_in_reach("x", "y", percent)).select(F.struct("x.n", "x.cls").alias("x"), F.struct("y.n", "y.cls").alias("y")).filter("x <> y")
    offered = offered.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = written(verified(not_disproved(offered, classes, percent), plain, size, percent))
    labels = components(first)

    own = shared.select("token", node.alias("node"), member.alias("member")).distinct()
    tagged = written(own.join(labels, "node", "left").select("token", "member", F.coalesce("label", "node").alias("label")))
    by_label = tagged.groupBy("token", "label").agg(F.count("*").alias("rows"))
    split = by_label.groupBy("token").agg(F.max_by("label", "rows").alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("token", "main")
    open_rows = tagged.join(split, "token")
    minor = open_rows.filter("label <> main").select("token", F.col("member").alias("x"), F.col("label").alias("label_x"))
    met = minor.join(open_rows.withColumnRenamed("member", "y"), "token").filter("label_x <> label and (label = main or struct(x.n, x.cls) < struct(y.n, y.cls))").filter(_in_reach("x", "y", percent))
    ends_of = (F.struct("x.n", "x.cls"), F.struct("y.n", "y.cls"))
    met = met.groupBy(F.least(*ends_of).alias("a"), F.greatest(*ends_of).alias("b")).agg(F.count("*").alias("matches"), F.min(F.least("x.need", "y.need")).alias("need"))
    candidates = met.filter("matches >= need").select("a", "b").join(offered, ["a", "b"], "left_anti")
    second = verified(not_disproved(candidates, classes, percent), plain, size, percent)
    return components(first.unionByName(second))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, counter_bits: int = COUNTER_BITS) -> DataFrame:
    """`id_col`, `n_shingles` and `component_id` (least id reachable by links of at least `percent` % Jaccard) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    signed = written(signatures(plain, size, counter_bits))
    counted = signed.filter("is_counter").groupBy("cls").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(1 << counter_bits, np.int64)
    counters[counted["cls"].to_numpy()] = counted["n"].to_numpy()
    background = counters.mean() + 4 * np.sqrt(counters.mean()) + 1
    others = np.maximum(counters - background, 0).astype(np.int64)
    rows = signed.filter("not is_counter")
    classes = written(rows.filter("n > 0 and id is not null").groupBy("n", "cls").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("bits").alias("bits")))

    with recorded() as searched:
        labels = _components(plain, others, classes, size, percent)
    release(*searched[:-1])  # all but the labels

    reps = classes.select(F.struct("n", "cls").alias("node"), "rep", "rows")
    least = labels.join(reps, "node").groupBy("label").agg(F.min("rep").alias("component"))
    joined = reps.join(labels.join(least, "label").select("node", "component"), "node", "left").filter("rows > 1 or component is not null")
    final = joined.select(F.col("node.n").alias("n"), F.col("node.cls").alias("cls"), F.coalesce("component", "rep").alias("component"))
    return rows.join(final, ["n", "cls"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, unchanged, of documents with the least id of their component; rows without an id stay.

    A document goes as a whole: with all rows of its id, if one belongs to another document's component.
    """
    with recorded() as made:
        gone = written(link(docs, id_col, text_col, size, percent).filter(f"component_id <> `{id_col}`").select(id_col).distinct())
    release(*made[:-1])
    return rows_without(docs, gone, id_col)
