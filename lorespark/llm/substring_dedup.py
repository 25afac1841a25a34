"""Substring dedup by compressed FM-indexes.

Runs of word windows that share an anchor (see `repeats`) meet in one task, which
indexes the documents' words there: suffix order, Burrows-Wheeler transform, and a
wavelet matrix over it whose bit rows are packed into 64-bit words with counts. The
windows are then streamed against the index: backward search takes all of them one
word to the left at a time and keeps the interval of suffixes that match so far; a
window leaves as soon as its interval holds no suffix of a document with a smaller
id (a least-value table over the suffix order tells). What reaches the full length
is a match of at least that many words, and is removed.

Windows never cross documents; a copy within its own document counts for nothing;
what is a copy is judged on the input.

Defined cases: a null text has no words; a row without an id is kept whole; rows
are kept one to one, and rows of equal id and text are one document; texts of
fewer words than the window are kept whole; words are compared as they are; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import repeats
from lorespark.llm.arrays import drop_model
from lorespark.llm.repeats import Units, Window
from lorespark.llm.suffix_dedup import dense


class WaveletMatrix:
    """Rank queries over a sequence of small numbers, bit by bit from the highest."""

    def __init__(self, sequence: np.ndarray, top: int) -> None:
        self.levels = max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            ones = (sequence >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([ones, np.zeros(-len(ones) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(ones) - ones.sum(dtype=np.int64)))
            sequence = np.concatenate([sequence[ones == 0], sequence[ones == 1]])

    def rank_one(self, depth: int, place: np.ndarray) -> np.ndarray:
        """Ones before each place of a bit row."""
        word = place >> 6
        below = self.bits[depth][word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[depth][word] + np.bitwise_count(below)

    def rank(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol comes before `low` and before `high`."""
        start = np.zeros(len(symbols), np.int64)
        for depth in range(self.levels):
            one = (symbols >> (self.levels - 1 - depth) & 1) == 1
            places = np.concatenate([start, low, high])
            ones = self.rank_one(depth, places).astype(np.int64)
            moved = np.where(np.tile(one, 3), self.zeros[depth] + ones, places - ones)
            start, low, high = np.split(moved, 3)
        return low - start, high - start


class FMIndex:
    """Index over texts of integer words; `owners` holds a number for each text, of which the least in an interval is asked."""

    def __init__(self, texts: np.ndarray, bounds: np.ndarray, owners: np.ndarray) -> None:
        # Every text ends in a mark of its own, so all suffixes differ; marks come before the words.
        count = len(bounds) - 1
        sizes = np.diff(bounds)
        self.size = len(texts) + count
        marked = np.empty(self.size, np.int64)
        ends = np.cumsum(sizes + 1) - 1
        is_end = np.zeros(self.size, np.bool_)
        is_end[ends] = True
        marked[is_end] = np.arange(count)
        self.words, inverse = np.unique(texts, return_inverse=True)
        marked[~is_end] = inverse + count
        ranks, reached = marked + 1, 1
        bits = int(self.size + 1).bit_length()
        while ranks.max() < self.size:
            key = np.zeros(self.size, np.int64)
            for at in range(max(2, 63 // bits)):
                key <<= bits
                key[: max(0, self.size - at * reached)] |= ranks[at * reached :]
            ranks, reached = dense(key) + 1, reached * max(2, 63 // bits)
        order = np.empty(self.size, np.int64)
        order[ranks - 1] = np.arange(self.size)
        # Marks become one symbol in the transform: no pattern holds them.
        symbols = np.where(is_end, 0, marked - count + 1)
        self.transform = WaveletMatrix(symbols[order - 1], len(self.words))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.words) + 1))])
        text_of = np.searchsorted(ends, order)
        self.least = [owners[text_of]]
        while 1 << len(self.least) <= self.size:
            half = 1 << len(self.least) - 1
            row = self.least[-1]
            self.least.append(np.minimum(row[: len(row) - half], row[half:]))

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least owner in each non-empty interval of the suffix order."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for one in np.unique(level).tolist():
            at = level == one
            row = self.least[one]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << one)])
        return out

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after putting one symbol (number of the word from 1) before the patterns."""
        first, last = self.transform.rank(symbols, low, high)
        return self.before[symbols] + first, self.before[symbols] + last


def earlier_windows(segments: list[tuple], window: Window, units: Units, rule: str) -> Iterator[tuple[int, int, int, int]]:
    """Spans of windows that also start in a document with a smaller id."""
    if rule != "earlier_document":
        raise ValueError("the index answers for earlier documents only")
    data = np.frombuffer(b"".join(row[5] for row in segments), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(row[5]) for row in segments])])
    values, bounds, _, _ = units.split(data, offsets)
    ids = np.array([row[1] for row in segments], np.int64)
    index = FMIndex(values, bounds, ids)
    symbols = np.searchsorted(index.words, values) + 1
    # Windows of the least document of an anchor have no earlier document.
    keys = np.array([row[0] for row in segments], np.int64)
    _, group = np.unique(keys, return_inverse=True)
    lowest = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, ids)
    count = np.where(ids > lowest[group], np.diff(bounds) - window.size + 1, 0)
    owner = np.repeat(np.arange(len(segments)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    alive = np.arange(len(owner))
    low, high = np.zeros(len(owner), np.int64), np.full(len(owner), index.size, np.int64)
    for back in range(1, window.size + 1):
        if not len(alive):
            break
        place = bounds[:-1][owner[alive]] + inside[alive] + window.size - back
        low, high = index.step(symbols[place], low, high)
        keep = high > low
        # Asking for the least owner costs as much as a step: at the start nearly all have one.
        if back % 8 == 0 or back == window.size:
            keep &= index.least_owner(low, np.maximum(high, low + 1)) < ids[owner[alive]]
        alive, low, high = alive[keep], low[keep], high[keep]
    owner, inside = owner[alive], inside[alive]
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)]) if len(owner) else np.empty(0, np.bool_)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(owner)) - 1
    for at, to in zip(starts.tolist(), ends.tolist()):
        row = segments[owner[at]]
        yield row[1], row[2], int(row[3] + inside[at]), int(row[3] + inside[to]) + window.size


def dedup(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `n_words`, `removed` (maximal runs as [start, end) words) and `kept` (remaining words joined by blanks) of every row."""
    if words < 10:
        raise ValueError("windows of fewer than 10 words are not looked for")
    keyed = repeats.keyed(docs, id_col, text_col)
    units = Units(words=True)
    spans = partial(repeats.repeated_spans, keyed, units, Window(words, words // 5), "earlier_document", earlier_windows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        separators = bytes(range(9, 14))
        blanks = bytes.maketrans(separators, b" " * len(separators))
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column(2), batch.column(3)):
                own = (text.as_py() or "").encode().translate(blanks).split(b" ")
                own = [word for word in own if word]
                runs = []
                if len(found):
                    data = np.frombuffer(text.as_py().encode(), np.uint8)
                    runs = repeats.same_windows(units.split(data, np.array([0, len(data)]))[0], found.as_py(), words)
                counts.append(len(own))
                removed.append([{"start": a, "end": b} for a, b in runs])
                bounds = [0, *[at for run in runs for at in run], len(own)]
                kept.append(b" ".join(word for a, b in zip(bounds[::2], bounds[1::2]) for word in own[a:b]).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "removed", "kept"])

    out = repeats.with_spans(keyed, spans, "id long, n_words long, removed array<struct<start:bigint,end:bigint>>, kept string", cut)
    return out.withColumnRenamed("id", id_col)


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the removed words and the digest of the kept ones."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda sum_, span: sum_ + span["end"] - span["start"])
    return removed.select(id_col, "n_words", total.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
