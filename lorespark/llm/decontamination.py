"""Benchmark decontamination by winnowed fingerprints.

Of every run of six neighbouring 5-word hashes the least is a fingerprint, so any
span of ten words that a document shares with a benchmark item shares a
fingerprint. The fingerprints of the documents meet those of the benchmark, and
each hit is extended: the ten-word windows around it are compared with the
items' windows, which gives exactly the covered words and the items they are of.
Items of fewer than ten words are one window of their own length.

The benchmark is processed in blocks of at most `block_words` words; a block is
what is broadcast. Documents are never shuffled. With one block there is one
pass; more blocks pass the documents again, with a written table between.

Defined cases: a null text has no words; an item without words never occurs; an
item id that comes twice is one item with both texts; a null item id is not
listed but its text counts as a hit; documents are kept one to one, repeated
rows and null ids included; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrays import SIGNS, bounded_batches, byte_values, class_table, gram_hashes, kept_model, range_hashes, text_slices, winnowed, word_spans
from lorespark.session import ship, written

WINDOW = 10
GRAM = 5
_TABLE = class_table(SIGNS, lower=True)
#: Words of benchmark text in one broadcast block, two bytes counted as one: 8 MB of text.
BLOCK_WORDS = 4_000_000


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and how many words precede each text."""
    mapped = _TABLE[data]
    starts, ends, bounds = word_spans(mapped, offsets)
    return range_hashes(byte_values(mapped), starts, ends), bounds


def fingerprints(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the fingerprints of all texts of a slice; texts of fewer than WINDOW words have none."""
    grams = gram_hashes(words, GRAM)
    if not len(grams):
        return np.empty(0, np.int64)
    # A 5-gram that crosses the end of its text gets the largest hash; a window of only such is dropped below.
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    crossing = owner[: len(grams)] != owner[GRAM - 1 :]
    places = winnowed(np.where(crossing, np.uint64(2**64 - 1), grams), WINDOW - GRAM + 1)
    return places[~crossing[places]]


class BenchmarkBlock:
    """Fingerprints and windows of some benchmark items."""

    def __init__(self, texts: list[str]) -> None:
        prints, windows = [], {}
        for _, data, offsets in text_slices(pa.array(texts, pa.large_string()), 1 << 40):
            words, bounds = hashed_words(data, offsets)
            prints = gram_hashes(words, GRAM)[fingerprints(words, bounds)] if len(words) >= GRAM else np.empty(0, np.uint64)
            sizes = np.diff(bounds)
            for size in np.unique(np.minimum(sizes, WINDOW)).tolist():
                if size:
                    chosen = np.flatnonzero(sizes == size if size < WINDOW else sizes >= WINDOW)
                    count = sizes[chosen] - size + 1
                    owner = np.repeat(chosen, count)
                    places = np.repeat(bounds[:-1][chosen] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    hashes = range_hashes(words, places, places + size)
                    order = np.lexsort((owner, hashes))
                    hashes, owner = hashes[order], owner[order]
                    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
                    windows[size] = (hashes[fresh], owner[fresh])
        self.prints = np.unique(np.asarray(prints, np.uint64))
        self.windows = windows

    def found(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(first word, size, low, high): matched places and their range in the sorted windows of that size."""
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for size, (hashes, _) in self.windows.items():
            if len(words) < size:
                continue
            if size == WINDOW:
                places = fingerprints(words, bounds)
                places = places[is_in(range_hashes(words, places, places + GRAM), self.prints)]
                # Extend each hit: the windows that hold it.
                places = np.unique((places[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            else:
                places = np.arange(len(words))
            places = places[(places >= 0) & (places + size <= len(words))]
            places = places[owner[places] == owner[places + size - 1]] if len(places) else places
            keys = range_hashes(words, places, places + size)
            low = np.searchsorted(hashes, keys, "left")
            high = np.searchsorted(hashes, keys, "right")
            hit = high > low
            yield places[hit], size, low[hit], high[hit]


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), np.bool_)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def mark_slice(block: BenchmarkBlock, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, and of all hit runs: text, first word, word after the last; pairs of text and item as one number each)."""
    words, bounds = hashed_words(data, offsets)
    change = np.zeros(len(words) + 1, np.int64)
    pairs = [np.empty(0, np.int64)]
    for places, size, low, high in block.found(words, bounds):
        np.add.at(change, places, 1)
        np.add.at(change, places + size, -1)
        texts = np.searchsorted(bounds, places, "right") - 1
        # One expansion for each window of a text, however often it occurs there.
        _, once = np.unique(np.stack([texts, low]), axis=1, return_index=True)
        texts, low, high = texts[once], low[once], high[once]
        count = high - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pairs.append(np.unique(np.repeat(texts, count) << 32 | block.windows[size][1][at]))
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edge = np.zeros(len(words) + 1, np.bool_)
    edge[bounds] = True
    first = np.flatnonzero(covered[1:] & (~covered[:-1] | edge))
    after = np.flatnonzero(covered[:-1] & (~covered[1:] | edge))
    texts = np.searchsorted(bounds, first, "right") - 1
    return np.diff(bounds), texts, first - bounds[texts], after - bounds[texts], np.unique(np.concatenate(pairs))


def _block(texts: tuple[str, ...]) -> BenchmarkBlock:
    return kept_model(texts, lambda: BenchmarkBlock(list(texts)))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """Rows of the benchmark in blocks of about `block_words` words each, by a hash of the text."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    # A word and its gap take two bytes at least; the blocks are bounded in any case.
    total = items.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    count = max(1, -(-int(total) // block_words))
    for number in range(count):
        rows = items if count == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == number)
        yield [(row.item, row.text) for row in rows.collect()]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, after in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(after, merged[-1][1]))
        else:
            merged.append((first, after))
    return merged


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`id_col`, `n_words`, `spans` (hit words as [first, after)) and `items` (ids as strings, sorted) of every document."""
    marked = _mark(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), "_text", benchmark, item_col, item_text_col, block_words)
    return marked.select(F.col("_id").alias(id_col), "n_words", "spans", F.array_sort("items").alias("items"))


def _mark(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int) -> DataFrame:
    """All columns of `docs` with n_words, spans and items; these three names must be free."""
    spark = docs.sparkSession
    bounded_batches(spark)
    state = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<struct<first:bigint,after:bigint>>)"), "items": F.expr("cast(array() as array<string>)")})
    place, width = docs.columns.index(text_col), len(docs.columns)
    for number, rows in enumerate(_blocks(benchmark, item_col, item_text_col, block_words)):
        shipped = ship(spark, (tuple(text for _, text in rows), [None if item is None else str(item) for item, _ in rows]))

        def work(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            texts, names = shipped.value
            block = _block(texts)
            for batch in batches:
                for first, data, offsets in text_slices(batch.column(place)):
                    part = batch.slice(first, len(offsets) - 1)
                    sizes, owners, starts, ends, pairs = mark_slice(block, data, offsets)
                    spans, items = part.column(width + 1).to_pylist(), part.column(width + 2).to_pylist()
                    fresh: dict[int, list] = {}
                    for owner, start, end in zip(owners.tolist(), starts.tolist(), ends.tolist()):
                        fresh.setdefault(owner, []).append((start, end))
                    for owner, runs in fresh.items():
                        spans[owner] = [{"first": a, "after": b} for a, b in _union([*runs, *((s["first"], s["after"]) for s in spans[owner])])]
                    named: dict[int, set] = {}
                    for pair in pairs.tolist():
                        if (name := names[pair & 0xFFFFFFFF]) is not None:
                            named.setdefault(pair >> 32, set()).add(name)
                    for owner, found in named.items():
                        items[owner] = sorted(found | set(items[owner]))
                    columns = [pa.array(sizes), pa.array(spans, part.schema.field(width + 1).type), pa.array(items, part.schema.field(width + 2).type)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], names=part.schema.names)

        state = (written(state) if number else state).mapInArrow(work, state.schema)
    return state


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, unchanged, that hold no window of the benchmark."""
    plain = docs.toDF(*[f"_{number}" for number in range(len(docs.columns))])
    marked = _mark(plain, f"_{docs.columns.index(text_col)}", benchmark, item_col, item_text_col, block_words)
    return marked.filter(F.size("spans") == 0).select(*[F.col(f"_{number}").alias(name) for number, name in enumerate(docs.columns)])


def digests(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the items of marked documents."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["after"] - span["first"])
    return marked.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )
