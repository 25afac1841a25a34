"""Suffix-array dedup: bytes covered by strings of a given length that occur more than once.

Runs of windows that share an anchor (see `repeats`) meet in one task. There the
suffixes of their bytes are ranked by doubling their depth, from eight-byte words
to the window's length, and sorted by that rank and then by position in the
corpus. In this order the longest-previous-factor of a suffix reaches the window's
length exactly when its previous smaller position does: among suffixes that agree
that far, positions ascend, so that position is the neighbour before, and the
first copy is the one that only the next neighbour refers to. `keep_first` removes
what has a previous factor; without it the first copies go as well.

Matches never cross documents; overlaps count; what is a copy is judged on the
input, not on what is left.

Defined cases: null text is empty; a row without an id is kept whole; rows are
kept one to one, and rows of equal id and text are one document (a copy of itself
counts for nothing); texts shorter than the length are kept whole; extra columns
are ignored.
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


def dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the different ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return ranks


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of `data` by their first `depth` bytes; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for place in range(8):
        word = word << np.uint64(8) | padded[place : place + len(data)]
    ranks, reached = dense(word) + 1, min(8, depth)
    bits = int(len(data) + 1).bit_length()
    while reached < depth:
        # As many neighbouring ranks as fit into one number; the last may overlap the one before.
        parts = max(2, 63 // bits)
        steps = [min(at * reached, depth - reached) for at in range(parts)]
        key = np.zeros(len(data), np.int64)
        for step in dict.fromkeys(steps):
            key <<= bits
            key[: max(0, len(data) - step)] |= ranks[step:]
        ranks, reached = dense(key) + 1, min(depth, reached + steps[-1])
    return ranks


def previous_factors(segments: list[tuple], window: Window, units: Units, rule: str) -> Iterator[tuple[int, int, int, int]]:
    """Spans of windows with an equal one at another place (`any`) or at a smaller one (`earlier`)."""
    segments.sort(key=lambda row: row[1:4])
    sizes = np.array([len(row[5]) for row in segments], np.int64)
    begin = np.cumsum(sizes) - sizes
    ranks = suffix_ranks(np.frombuffer(b"".join(row[5] for row in segments), np.uint8), window.size)
    count = sizes - window.size + 1
    owner = np.repeat(np.arange(len(segments)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    rank = ranks[begin[owner] + inside]
    order = np.argsort(rank, kind="stable")  # positions ascend among equals
    equal = rank[order[1:]] == rank[order[:-1]]
    copied = np.zeros(len(rank), np.bool_)
    copied[order[1:][equal]] = True
    if rule == "any":
        copied[order[:-1][equal]] = True
    owner, inside = owner[copied], inside[copied]
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)]) if len(owner) else np.empty(0, np.bool_)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(owner)) - 1
    for at, to in zip(starts.tolist(), ends.tolist()):
        row = segments[owner[at]]
        yield row[1], row[2], int(row[3] + inside[at]), int(row[3] + inside[to]) + window.size


def dedup(docs: DataFrame, length: int = 200, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `n_bytes`, `removed` (maximal runs as [start, end) bytes) and `kept` (remaining bytes) of every row."""
    if length < 16:
        raise ValueError("strings of fewer than 16 bytes are not looked for")
    keyed = repeats.keyed(docs, id_col, text_col)
    spans = partial(repeats.repeated_spans, keyed, Units(words=False), Window(length, length // 5), "earlier" if keep_first else "any", previous_factors)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, found in zip(batch.column(2), batch.column(3)):
                data = (text.as_py() or "").encode()
                runs = repeats.union_of(found.as_py())
                sizes.append(len(data))
                removed.append([{"start": a, "end": b} for a, b in runs])
                bounds = [0, *[at for run in runs for at in run], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2])) if runs else data)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "removed", "kept"])

    out = repeats.with_spans(keyed, spans, "id long, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary", cut)
    return out.withColumnRenamed("id", id_col)


def shorten(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows of `docs` without later copies of strings of `length` bytes; `chars_col`, if given, is counted anew.

    A character that loses some of its bytes goes as a whole. A null text stays null.
    """
    keyed = repeats.keyed(docs, id_col, text_col)
    spans = partial(repeats.repeated_spans, keyed, Units(words=False), Window(length, length // 5), "earlier", previous_factors)
    text = F.col(f"`{text_col}`").cast("string")
    # The row itself goes along under names that cannot clash.
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), F.struct(*[F.col(f"`{name}`").alias(f"_{n}") for n, name in enumerate(docs.columns) if name != text_col]).alias("rest"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, found in enumerate(batch.column(4).to_pylist()):
                if found:
                    data = texts[at].encode()
                    bounds = [0, *[place for run in repeats.union_of(found) for place in run], len(data)]
                    texts[at] = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2])).decode(errors="ignore")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3)], ["text", "rest"])

    rest = whole.schema["rest"].dataType.simpleString()
    out = repeats.with_spans(whole, spans, f"text string, rest {rest}", cut)
    columns = [F.col("text").alias(name) if name == text_col else F.col(f"rest._{n}").alias(name) for n, name in enumerate(docs.columns)]
    shortened = out.select(*columns)
    return shortened.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col else shortened


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the removed bytes and the digest of the kept ones."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda sum_, span: sum_ + span["end"] - span["start"])
    return removed.select(id_col, "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
