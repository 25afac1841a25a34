"""Windows of fixed length that occur more than once in a corpus: what the two substring operators share.

A text is a row of units (bytes or words). Each window of `window` units has an
anchor: the `gram`-unit string in it with the least hash. Equal windows have equal
anchors at equal places, so a window need only be compared with windows of the
same anchor. Neighbouring windows with one anchor are a run.

1. Anchors are counted; runs whose anchor may occur twice (a bitmap of fixed size
   tells) are written as numbers only.
2. Runs that are equal as a whole are settled by an aggregate, however many there
   are: a hot passage costs one row of partial counts for each task.
3. Of runs that differ although they share an anchor one copy each is fetched with
   its units and goes to the task of its anchor, where a matcher finds the equal
   windows. An anchor with more than HOT_RUNS different runs is first split into
   narrow runs, keyed by all the units these have in common, then into single
   windows, which the aggregate settles.

Which windows count is the rule: `any` (it also starts elsewhere), `earlier` (it
also starts at a smaller place: id, then position) or `earlier_document` (it also
starts in a document with a smaller id; of equal windows in one document one is
enough, `same_windows` finds the others in the document itself).

Rows without an id are not compared. Rows of equal id and text are one document;
rows of equal id are told apart by a hash of their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrays import SPACED, bounded_batches, byte_values, class_table, drop_model, gram_hashes, mix, range_hashes, text_slices, window_anchors, word_spans
from lorespark.llm.lookup import filter_rows, id_bitmap, key_bitmap, marked, merged, row_filter, with_place
from lorespark.session import recorded, release, ship, written

#: Different runs of one anchor that a single task compares.
HOT_RUNS = 2000
#: Bytes of runs that a matcher works on together.
CHUNK_BYTES = 1 << 19
_WORDS = class_table(SPACED, lower=False)
_PLACE_OF_ID = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Units:
    """How a text falls into units."""

    words: bool

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each unit, units before each text, first byte of each unit, byte after it)."""
        if not self.words:
            places = np.arange(len(data))
            return byte_values(data), offsets, places, places + 1
        mapped = _WORDS[data]
        starts, ends, bounds = word_spans(mapped, offsets)
        return range_hashes(byte_values(mapped), starts, ends), bounds, starts, ends


@dataclass(frozen=True)
class Window:
    size: int
    gram: int

    @property
    def grams(self) -> int:
        return self.size - self.gram + 1


@dataclass
class Runs:
    """Runs of a slice: text, first and last window, anchor place (all as places in the slice), anchor hash and hash of the run."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    run: np.ndarray


def runs_of(units: np.ndarray, bounds: np.ndarray, window: Window) -> Runs:
    anchors = window_anchors(gram_hashes(units, window.gram), window.grams)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[: len(anchors)] == owner[window.size - 1 :] if len(anchors) else np.empty(0, np.bool_)
    change = anchors[1:] != anchors[:-1]
    first = np.flatnonzero(inside & np.concatenate([np.ones(min(1, len(anchors)), np.bool_), change | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], np.ones(min(1, len(anchors)), np.bool_)]))
    anchor = anchors[first]
    key = range_hashes(units, anchor, anchor + window.gram)
    run = mix(range_hashes(units, first, last + window.size) + (anchor - first).astype(np.uint64))
    return Runs(owner[first], first, last, anchor, key, run)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def spot_of(run: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for a run at its place."""
    return mix(run ^ mix(ids.view(np.uint64) * _PLACE_OF_ID + first.astype(np.uint64)))


def _scan(docs: DataFrame, units: Units, window: Window, rows: Callable, schema: str) -> DataFrame:
    """`rows(batch columns of the slice's texts, data, unit starts, unit ends, bounds, runs)` for all slices with windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2)):
                values, bounds, starts, ends = units.split(data, offsets)
                runs = runs_of(values, bounds, window)
                if len(runs.first):
                    ids = batch.column(0).slice(first, len(offsets) - 1).to_numpy()
                    hashes = batch.column(1).slice(first, len(offsets) - 1).to_numpy()
                    yield rows(ids, hashes, data, starts, ends, bounds, runs)

    return docs.mapInArrow(work, schema)


RUN = "key long, run long, id long, th long, first int, last int, off int, spot long"


def _run_columns(ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, runs: Runs, keep: np.ndarray) -> list[pa.Array]:
    base = bounds[runs.text[keep]]
    own, first = ids[runs.text[keep]], runs.first[keep] - base
    numbers = [first, runs.last[keep] - base, runs.anchor[keep] - runs.first[keep]]
    return [_long(runs.key[keep]), _long(runs.run[keep]), pa.array(own), pa.array(hashes[runs.text[keep]]), *[pa.array(x.astype(np.int32)) for x in numbers], _long(spot_of(runs.run[keep], own, first))]


_NAMES = [part.split()[0] for part in RUN.split(", ")]


def repeated_spans(docs: DataFrame, units: Units, window: Window, rule: str, matcher: Callable) -> DataFrame:
    """(id, th, start, end) in units: spans of windows that count by the rule; they may overlap.

    `docs` has id (long), th (hash of the text) and text. `matcher(segments, window,
    units, rule)` yields spans for a list of segments of whole anchors.
    """
    spark = docs.sparkSession
    docs = docs.filter("id is not null and text is not null")

    keys = _scan(docs, units, window, lambda ids, hashes, data, starts, ends, bounds, runs: pa.RecordBatch.from_arrays([_long(runs.key)], ["key"]), "key long")
    often = ship(spark, key_bitmap(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"))

    def noted(ids, hashes, data, starts, ends, bounds, runs):
        keep = np.flatnonzero(marked(often.value, runs.key))
        return pa.RecordBatch.from_arrays(_run_columns(ids, hashes, bounds, runs, keep), _NAMES)

    runs = written(_scan(docs, units, window, noted, RUN))
    spans, settled = settle(runs, window, rule)
    open_runs = settled.join(settled.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key", "left_semi")
    wanted = ship(spark, key_bitmap(open_runs, "spot"))

    def fetched(ids, hashes, data, starts, ends, bounds, runs):
        spot = spot_of(runs.run, ids[runs.text], runs.first - bounds[runs.text])
        keep = np.flatnonzero(marked(often.value, runs.key) & marked(wanted.value, spot))
        from_byte, to_byte = starts[runs.first[keep]], ends[runs.last[keep] + window.size - 1]
        pieces = [data[a:b].tobytes() for a, b in zip(from_byte.tolist(), to_byte.tolist())]
        return pa.RecordBatch.from_arrays([*_run_columns(ids, hashes, bounds, runs, keep), pa.array(pieces, pa.binary())], [*_NAMES, "piece"])

    segments = written(_scan(docs, units, window, fetched, f"{RUN}, piece binary"))
    found = [spans]
    for width in (max(2, window.grams // 10), 1):
        hot = segments.groupBy("key").agg(F.count("*").alias("n")).filter(f"n > {HOT_RUNS}").select("key")
        bitmap = ship(spark, key_bitmap(hot, "key"))
        found.append(matched(segments.mapInArrow(by_heat(bitmap, False), segments.schema), units, window, rule, matcher))
        narrow = written(split_runs(segments, bitmap, units, window, width))
        spans, settled = settle(narrow.drop("piece"), window, rule)
        found.append(spans)
        # One copy of each different run goes on, where its key has several.
        several = settled.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        segments = narrow.join(settled.join(several, "key", "left_semi").select("run", "id", "th", "first"), ["run", "id", "th", "first"], "left_semi").select(*[F.col(x) for x in segments.columns])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def settle(runs: DataFrame, window: Window, rule: str) -> tuple[DataFrame, DataFrame]:
    """(spans of runs that equal another run and count by the rule, one copy of each different run)."""
    place = F.struct("id", "th", "first", "last", "off", "key", "spot")
    each = written(runs.groupBy("run").agg(F.min(place).alias("least"), F.max(F.struct("id", "th", "first")).alias("most")))
    least = F.col("least")
    same = (least["id"] == F.col("most.id")) & (least["th"] == F.col("most.th")) & (least["first"] == F.col("most.first"))
    again = each.filter(~same).select("run", least["id"].alias("id0"), least["th"].alias("th0"), least["first"].alias("first0"))
    counts = {"any": F.lit(True), "earlier": F.struct("id", "th", "first") > F.struct("id0", "th0", "first0"), "earlier_document": F.col("id") > F.col("id0")}[rule]
    spans = runs.select("run", "id", "th", "first", "last").join(again, "run").filter(counts)
    one = each.select("run", *[least[name].alias(name) for name in ("id", "th", "first", "last", "off", "key", "spot")])
    return spans.select("id", "th", F.col("first").alias("start"), (F.col("last") + window.size).alias("end")), one


def by_heat(bitmap, hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step that passes segments whose key is in the bitmap or not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = marked(bitmap.value, batch.column(0).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(found if hot else ~found))

    return work


def split_runs(segments: DataFrame, bitmap, units: Units, window: Window, width: int) -> DataFrame:
    """Segments of hot keys, cut where the distance from window to anchor passes a multiple of `width`.

    The key of a part is all that its windows must have in common: from the anchor
    less the smallest distance to the end of the window with the largest.
    """

    hot = by_heat(bitmap, True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hot(batches):
            columns: list[list] = [[] for _ in range(9)]
            for key, _, own, th, first, last, off, _, piece in zip(*[column.to_pylist() for column in batch.columns]):
                data = np.frombuffer(piece, np.uint8)
                values, _, starts, ends = units.split(data, np.array([0, len(data)]))
                low = off - (last - first)
                for near in range(low // width * width, off + 1, width):
                    # Windows whose distance to the anchor lies in [near, far].
                    far = near + width - 1
                    a, b = max(0, off - far), min(last - first, off - near)
                    core_hash = range_hashes(values, np.array([off - near]), np.array([off - far + window.size]))
                    part_key = mix(core_hash + np.uint64(key & 0xFFFFFFFFFFFF) + np.uint64(near))
                    run = mix(range_hashes(values, np.array([a]), np.array([b + window.size])) + np.uint64(off - a) + part_key)
                    new = [part_key.view(np.int64)[0], run.view(np.int64)[0], own, th, first + a, first + b, off - a]
                    spot = spot_of(run, np.array([own]), np.array([first + a])).view(np.int64)[0]
                    for column, value in zip(columns, [*new, spot, piece[starts[a] : ends[b + window.size - 1]]]):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, batch.schema)], names=batch.schema.names)

    return segments.mapInArrow(work, segments.schema)


def matched(segments: DataFrame, units: Units, window: Window, rule: str, matcher: Callable) -> DataFrame:
    """Spans that the matcher finds among the segments of each anchor."""

    def chunk(rows: list[tuple]) -> pa.RecordBatch:
        spans = list(matcher(list(dict.fromkeys(rows)), window, units, rule)) if rows else []
        columns = list(zip(*spans)) if spans else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], ["id", "th", "start", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        rows: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if size > CHUNK_BYTES and row[0] != key:
                    yield chunk(rows)
                    rows, size = [], 0
                key = row[0]
                rows.append(row)
                size += len(row[-1])
        yield chunk(rows)

    ordered = segments.select("key", "id", "th", "first", "last", "piece").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(work, "id long, th long, start long, end long")


def with_spans(docs: DataFrame, find: Callable[[], DataFrame], schema: str, finish: Callable) -> DataFrame:
    """`finish(batch)` over docs with the merged spans of `find()` as last column `spans`; docs that surely have none are not shuffled.

    `docs` has id, th, text and whatever else is wanted; each task of `finish` gets
    the columns of docs and then the list of (start, end).
    """
    with recorded() as made:
        grouped = written(find().groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))
    release(*made[:-1])
    bitmap = id_bitmap(grouped, "id")
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    renamed = grouped.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans")
    near = filter_rows(docs, bitmap, "id")
    joined = near.join(merged(renamed), (near["id"] == F.col("_id")) & (near["th"] == F.col("_th")), "left").select(*docs.columns, F.coalesce("spans", empty).alias("spans"))
    apart = row_filter(docs, bitmap, False)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Filter and finish in one worker.
        spanless = (pa.RecordBatch.from_arrays([*batch.columns, pa.array([[]] * len(batch), kind)], names=[*batch.schema.names, "spans"]) for batch in apart(batches))
        yield from finish(spanless)

    return joined.mapInArrow(finish, schema).unionByName(with_place(docs, "id").mapInArrow(finish_apart, schema))


def same_windows(units: np.ndarray, spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by all windows of a document that equal a window of one of the spans.

    Spans are taken one by one: a window across two that touch is of neither.
    """
    starts = np.arange(len(units) - size + 1)
    hashes = range_hashes(units, starts, starts + size)
    inside = np.zeros(len(starts), np.bool_)
    for span in spans:
        inside[span["start"] : span["end"] - size + 1] = True
    found = np.flatnonzero(np.isin(hashes, hashes[inside]))
    return union_of([{"start": at, "end": at + size} for at in found.tolist()])


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans."""
    merged: list[tuple[int, int]] = []
    for span in spans or []:
        if merged and span["start"] <= merged[-1][1]:
            if span["end"] > merged[-1][1]:
                merged[-1] = (merged[-1][0], span["end"])
        else:
            merged.append((span["start"], span["end"]))
    return merged


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th and text of documents."""
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
