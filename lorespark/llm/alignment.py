"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut the bytes of a text differently. Where a token of both ends at
the same byte the text is cut into groups, and the two tokens that end there are
linked. How often an (A id, B id) pair is linked over all documents tells which A
token stands for a B token.

Documents are numbered inside segments (at most 65,536 documents or about
SEGMENT_LINKS links). A segment's posting list holds for each pair bit planes of
documents: plane j marks those whose number of links of this pair has bit j set.
A plane is stored as sorted 16-bit numbers, or as a bitmap of 8 KB where that is
smaller. The planes of a pair are OR-merged and popcounted for its documents;
2**j times the popcount of plane j adds up to its links. Counts of all segments
are added in Spark, and go back to the documents through the same postings.

Each text is tokenized once: document rows and postings are written as one table in
the shared folder. A pair has one posting a segment at most, so no pair is a hot
key; what a task holds is bounded by a segment, or by one document beyond it.

Defined cases: a text that is null, empty, or that either tokenizer does not give
back byte by byte has no tokens: zeros and an empty digest. Repeated rows and null
ids are kept one to one, and each counts. Ties for the highest count all count as
best. Columns other than those named are ignored. Vocabularies with an empty token
raise ValueError.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.arrays import bounded_batches, drop_model, kept_model, text_slices
from lorespark.session import written

#: Documents of a segment: their numbers have 16 bits.
SEGMENT_DOCUMENTS = 1 << 16
#: Links of a segment; a longer document is a segment of its own.
SEGMENT_LINKS = 1 << 20
#: A plane of more documents than this is a bitmap of 65,536 bits.
DENSE = 4096
_BITMAP_BYTES = SEGMENT_DOCUMENTS // 8
_B_BITS = 31


@dataclass(frozen=True)
class Tokenizers:
    """The content of both vocabulary files, as tasks receive it."""

    ranks: dict[bytes, int]  # A: token bytes to id, which is also the rank of the merge
    pattern: str  # A: what is merged separately
    pieces: bytes  # B: the model file


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 signs stand for themselves, the others follow U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + at): byte for at, byte in enumerate(hidden)}


def read_tokenizers(byte_level_path: str, pattern: str, pieces_path: str) -> Tokenizers:
    """A from the JSON file of a byte-level BPE whose ids are in the order of merges, B from a piece model file."""
    with open(byte_level_path, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    special = {token["content"] for token in content["added_tokens"]}
    ranks = {bytes(letters[letter] for letter in token): number for token, number in content["model"]["vocab"].items() if token not in special}
    with open(pieces_path, "rb") as file:
        return Tokenizers(ranks, pattern, file.read())


def _flat(table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(one) for one in table], np.int64)
    return sizes, np.cumsum(sizes) - sizes


class Aligner:
    """Both tokenizers and their tokens as bytes."""

    def __init__(self, files: Tokenizers) -> None:
        self.a = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=files.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        self.a_bytes = [b""] * (max(files.ranks.values()) + 1)
        for token, number in files.ranks.items():
            self.a_bytes[number] = token
        self.b_bytes = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode() for number, piece in ((number, self.b.id_to_piece(number)) for number in range(self.b.get_piece_size()))]
        if not all(map(len, files.ranks)) or not all(map(len, self.b_bytes)):
            raise ValueError("a token without bytes")
        self.a_sizes = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        most = max(len(self.a_bytes), len(self.b_bytes))
        # Decimal ids with what may follow them.
        self.written = np.array([f"{number}{mark}" for number in range(most) for mark in ",|;"], "S")
        self.widths = np.char.str_len(self.written).astype(np.int64)
        self.letters = self.written.view(np.uint8).reshape(len(self.written), -1)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; none where the bytes do not come back."""
        spaced = [" " + text for text in texts]
        a, b = [self.a.encode_ordinary(text) if len(text) > 1 else [] for text in spaced], self.b.encode(texts, num_threads=1)
        for at, text in enumerate(spaced):
            whole = text.encode()
            if len(whole) == 1 or b"".join([self.a_bytes[i] for i in a[at]]) != whole or b"".join([self.b_bytes[i] for i in b[at]]) != whole:
                a[at], b[at] = [], []
        return a, b

    def align(self, texts: list[str]) -> Aligned:
        a_lists, b_lists = self.encode(texts)
        rows = len(texts)
        n_a, n_b = np.array(list(map(len, a_lists)), np.int64), np.array(list(map(len, b_lists)), np.int64)
        a = np.fromiter((i for one in a_lists for i in one), np.int64, int(n_a.sum()))
        b = np.fromiter((i for one in b_lists for i in one), np.int64, int(n_b.sum()))
        # Byte offsets run on from text to text: both sides of a text have the same bytes.
        _, last_a, last_b = np.intersect1d(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), assume_unique=True, return_indices=True)
        owner = np.repeat(np.arange(rows), n_a)[last_a]
        return Aligned(rows, n_a, n_b, a, b, last_a, last_b, owner)

    def notation(self, found: Aligned) -> list[memoryview]:
        """`a1,a2|b1;a3|b2,b3` of each text: ids of A and B, group by group."""
        a_group = np.searchsorted(found.last_a, np.arange(len(found.a)))
        b_group = np.searchsorted(found.last_b, np.arange(len(found.b)))
        code = np.empty(len(found.a) + len(found.b), np.int64)
        ends_a, ends_b = np.zeros(len(found.a), np.int64), np.zeros(len(found.b), np.int64)
        ends_a[found.last_a], ends_b[found.last_b] = 1, 2
        code[np.arange(len(found.a)) + np.append(0, found.last_b + 1)[a_group]] = found.a * 3 + ends_a
        code[np.arange(len(found.b)) + (found.last_a + 1)[b_group]] = found.b * 3 + ends_b
        widths = self.widths[code]
        flat = memoryview(self.letters[code][np.arange(self.letters.shape[1]) < widths[:, None]])
        tokens = np.append(0, np.cumsum(found.n_a + found.n_b))
        bounds = np.append(0, np.cumsum(widths))[tokens].tolist()
        return [flat[start : max(start, end - 1)] for start, end in zip(bounds, bounds[1:])]


@dataclass(frozen=True)
class Aligned:
    rows: int
    n_a: np.ndarray
    n_b: np.ndarray
    a: np.ndarray  # ids of all texts, one after the other
    b: np.ndarray
    last_a: np.ndarray  # places in `a` and `b` where groups end: the linked tokens
    last_b: np.ndarray
    owner: np.ndarray  # text of each group

    def pairs(self) -> np.ndarray:
        return self.a[self.last_a] << _B_BITS | self.b[self.last_b]


def posting_lists(pairs: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The different pairs of a segment and the planes of each: `pairs[i]` is linked once more in document `slots[i]`."""
    found, number = np.unique(pairs, return_inverse=True)
    entries, links = np.unique(number.astype(np.int64) << 16 | slots, return_counts=True)
    owner = entries >> 16
    most = np.zeros(len(found), np.int64)
    np.maximum.at(most, owner, links)
    depth = np.ceil(np.log2(most + 1)).astype(np.int64)  # planes of each pair
    cells = np.append(0, np.cumsum(depth))
    plane_of, slot_of = [], []
    for plane in range(int(depth.max(initial=0))):
        set_here = (links >> plane & 1) == 1
        plane_of.append(cells[owner[set_here]] + plane)
        slot_of.append(entries[set_here] & 0xFFFF)
    order = np.sort(np.concatenate(plane_of) << 16 | np.concatenate(slot_of)) if plane_of else np.empty(0, np.int64)
    sizes = np.bincount(order >> 16, minlength=int(cells[-1]))
    listed = (order & 0xFFFF).astype("<u2")
    data, lengths = listed.view(np.uint8), sizes * 2
    if (sizes > DENSE).any():
        starts, pieces = np.append(0, np.cumsum(sizes)), []
        done = 0
        for cell in np.flatnonzero(sizes > DENSE):
            bits = np.zeros(SEGMENT_DOCUMENTS, np.uint8)
            bits[listed[starts[cell] : starts[cell + 1]]] = 1
            pieces += [listed[done : starts[cell]].view(np.uint8), np.packbits(bits, bitorder="little")]
            done = starts[cell + 1]
        data, lengths = np.concatenate([*pieces, listed[done:].view(np.uint8)]), np.where(sizes > DENSE, _BITMAP_BYTES, lengths)
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    planes = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return found, pa.ListArray.from_arrays(pa.array(cells.astype(np.int32)), planes)


def members(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, plane, document) of all bits that are set."""
    outer = planes.offsets.to_numpy().astype(np.int64)
    cells = planes.flatten()
    row = np.repeat(np.arange(len(planes)), np.diff(outer))
    plane = np.arange(len(cells)) - np.repeat(outer[:-1] - outer[0], np.diff(outer))
    bounds = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    sizes = np.diff(bounds)
    dense = sizes == _BITMAP_BYTES
    cell, slot = np.repeat(np.arange(len(cells)), np.where(dense, 0, sizes // 2)), None
    if dense.any():
        slot = np.frombuffer(data[np.repeat(~dense, sizes)].tobytes(), "<u2").astype(np.int64)
        whole = [(at, np.flatnonzero(np.unpackbits(data[bounds[at] - bounds[0] : bounds[at + 1] - bounds[0]], bitorder="little"))) for at in np.flatnonzero(dense)]
        cell = np.concatenate([cell, *[np.full(len(bits), at) for at, bits in whole]])
        slot = np.concatenate([slot, *[bits for _, bits in whole]])
    else:
        slot = np.frombuffer(data.tobytes(), "<u2").astype(np.int64)
    return row[cell], plane[cell], slot


def aligned_table(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents (`slot` is not null) and postings (`pair` is not null) of all segments, written to the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(files)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"segment long, slot int, id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pair long, planes array<binary>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner: Aligner = kept_model("alignment", lambda: Aligner(shipped.value))
        # A repeated task sees the same rows under the same number, and so names the same segments.
        segment, used, size = TaskContext.get().partitionId() << 32, 0, 0
        pairs: list[np.ndarray] = []
        slots: list[np.ndarray] = []
        names = ["segment", "slot", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pair", "planes"]
        planes_type = pa.list_(pa.binary())

        def postings() -> pa.RecordBatch:
            found, planes = posting_lists(np.concatenate(pairs), np.concatenate(slots))
            none = lambda type: pa.nulls(len(found), type)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), segment)), none(pa.int32()), none(id_type), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.string()), pa.array(found), planes], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for first, _, offsets in text_slices(batch.column(1)):
                rows = len(offsets) - 1
                found = aligner.align(batch.column(1).slice(first, rows).fill_null("").to_pylist())
                groups = np.bincount(found.owner, minlength=rows)
                if pairs and (used + rows > SEGMENT_DOCUMENTS or size + len(found.owner) > SEGMENT_LINKS):
                    yield postings()
                    pairs, slots, used, size, segment = [], [], 0, 0, segment + 1
                digests = [hashlib.sha256(one).hexdigest() if len(one) else "" for one in aligner.notation(found)]
                numbers = pa.array(np.arange(used, used + rows), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, segment)), numbers, batch.column(0).slice(first, rows), pa.array(found.n_a), pa.array(found.n_b), pa.array(groups), pa.array(digests, pa.string()), pa.nulls(rows, pa.int64()), pa.nulls(rows, planes_type)], names)
                pairs.append(found.pairs())
                slots.append(found.owner + used)
                used, size = used + rows, size + len(found.owner)
        if size:
            yield postings()

    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(work, schema))


def pair_counts(table: DataFrame) -> DataFrame:
    """`pair`, `a_id`, `b_id`, `n_docs`, `n_links` and whether no other A id is linked with this B id more often (`best`)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            row, plane, slot = members(batch.column(1))
            links = np.zeros(len(batch), np.int64)
            np.add.at(links, row, np.int64(1) << plane)
            merged = np.unique(row << 16 | slot) >> 16  # the planes of a pair OR-merged
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(merged, minlength=len(batch))), pa.array(links)], ["pair", "n_docs", "n_links"])

    counted = table.filter("pair IS NOT NULL").select("pair", "planes").mapInArrow(work, "pair long, n_docs long, n_links long")
    total = counted.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    # One B id meets at most as many A ids as the vocabulary has.
    split = total.select("pair", F.shiftright("pair", _B_BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << _B_BITS) - 1).cast("int").alias("b_id"), "n_docs", "n_links")
    return split.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b_id")))


def returned(table: DataFrame, counts: DataFrame) -> DataFrame:
    """`segment`, `slot`, `n_best` and `count_sum` of the documents that hold links: counts go back through the postings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        current, best, sums = None, np.zeros(SEGMENT_DOCUMENTS, np.int64), np.zeros(SEGMENT_DOCUMENTS, np.int64)

        def gathered() -> pa.RecordBatch:
            held = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), current)), pa.array(held, pa.int32()), pa.array(best[held]), pa.array(sums[held])], ["segment", "slot", "n_best", "count_sum"])

        for batch in batches:
            segments = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), len(segments)]
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                if segments[start] != current:
                    if current is not None:
                        yield gathered()
                        best[:], sums[:] = 0, 0
                    current = int(segments[start])
                part = batch.slice(start, end - start)
                row, plane, slot = members(part.column(1))
                np.add.at(sums, slot, part.column(2).to_numpy()[row] << plane)
                np.add.at(best, slot, part.column(3).cast(pa.int64()).to_numpy()[row] << plane)
        if current is not None:
            yield gathered()

    scored = table.filter("pair IS NOT NULL").select("segment", "pair", "planes").join(counts.select("pair", "n_links", "best"), "pair").select("segment", "planes", "n_links", "best")
    return scored.repartition("segment").sortWithinPartitions("segment").mapInArrow(work, "segment long, slot int, n_best long, count_sum long")


def align(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = aligned_table(docs, files, id_col, text_col)
    sums = returned(table, pair_counts(table))
    rows = table.filter("slot IS NOT NULL").select("segment", "slot", "id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, ["segment", "slot"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return rows.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def groups(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups of every document as text, `a1,a2|b1;a3|b2,b3`."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(files)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner: Aligner = kept_model("alignment", lambda: Aligner(shipped.value))
        for batch in batches:
            for first, _, offsets in text_slices(batch.column(1)):
                rows = len(offsets) - 1
                found = aligner.align(batch.column(1).slice(first, rows).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array([bytes(one).decode() for one in aligner.notation(found)], pa.string())], ["_id", "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(work, f"_id {kind}, groups string").select(F.col("_id").alias(id_col), "groups")
