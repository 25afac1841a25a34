"""Byte-level BPE encoding and decoding.

A piece of text (one match of the split pattern) becomes bytes, and the bytes
become Latin-1 characters, so that one automaton over the vocabulary finds all
tokens in it. The encoder walks over the piece with the longest token at each
place. Two tokens may stand side by side only if the merges would leave exactly
these two; that answer is memoised for each pair. When no token fits, the walk
goes back and tries the next shorter one; a place that failed is never entered
again, so the work is linear in the piece. A list of tokens whose neighbours all
fit is the one that the merges make.

Defined cases: null text is empty text and has no tokens; rows are kept one to
one, repeated rows and null ids included; columns other than the id and the text
are ignored, so their names cannot clash; an empty table gives an empty table.
A vocabulary must hold all 256 single bytes, or ValueError is raised.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrays import bounded_batches, kept_model, text_slices

#: A vocabulary travels to the executors with the job; a larger file is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces whose ids a worker remembers.
REMEMBERED_PIECES = 200_000
#: Bytes of text that are encoded before the result leaves the worker; decoding needs some thirty times as many.
OUTPUT_BYTES = 1 << 17


def read_ranks(path: str) -> bytes:
    """The rank file as it is: a line for each token, base64 and rank."""
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY_BYTES} bytes")
    return content


class _Remembered(dict):
    """Ids of pieces as packed 32-bit integers."""

    def __init__(self, codec: BytePairCodec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.codec.encode_piece(piece.encode()), np.int32).tobytes()
        if len(self) < REMEMBERED_PIECES:
            self[piece] = packed
        return packed


class BytePairCodec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        pairs = [line.split() for line in ranks.splitlines() if line]
        self.tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        if any(bytes([value]) not in self.ranks for value in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.find_pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.fits: dict[int, bool] = {}
        self.shorter_tokens: dict[int, int] = {}
        self.remembered = _Remembered(self)
        top = max(self.tokens) + 1
        self.token_sizes = np.zeros(top, np.int64)
        self.token_sizes[list(self.lengths)] = list(self.lengths.values())
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(self.tokens.get(rank, b"") for rank in range(top)), np.uint8)

    def merged(self, data: bytes) -> list[int]:
        """Ids by the merges themselves, lowest rank first: for the few bytes of two tokens."""
        parts = [data[at : at + 1] for at in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[at] + parts[at + 1], 1 << 62), at) for at in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self.fits) < 2 * REMEMBERED_PIECES:
                self.fits[pair] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        known = self.shorter_tokens.get(token)
        if known is None:
            data = self.tokens[token]
            known = next((self.ranks[data[:size]] for size in range(len(data) - 1, 0, -1) if data[:size] in self.ranks), -1)
            self.shorter_tokens[token] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        lengths = self.lengths
        longest = [-1] * len(data)
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end - lengths[token] + 1] = token  # ends only grow: the last one is the longest
        chosen: list[int] = []
        failed = bytearray(len(data) + 1)
        at, token = 0, longest[0]
        while at < len(data):
            while token >= 0:
                after = at + lengths[token]
                if not failed[after] and (not chosen or self.compatible(chosen[-1], token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                chosen.append(token)
                at = after
                token = longest[at] if at < len(data) else -1
            else:
                failed[at] = 1
                token = chosen.pop()
                at -= lengths[token]
                token = self.shorter(token)
        return chosen

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed 32-bit integers."""
        return b"".join(map(self.remembered.__getitem__, self.find_pieces(text)))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids."""
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.token_starts[ids] - (ends - sizes), sizes)
        places += np.arange(len(places))
        return self.token_bytes[places]


def _codec(ranks: bytes, pattern: str) -> BytePairCodec:
    return kept_model((ranks, pattern), lambda: BytePairCodec(ranks, pattern))


def _encoded(codec: BytePairCodec, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids of each text; also all ids and their bounds by text."""
    packed = [codec.encode(text) if text else b"" for text in texts.to_pylist()]
    bounds = np.cumsum([0, *map(len, packed)]) // 4
    ids = np.frombuffer(b"".join(packed), np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), ids, bounds


def _decoded(codec: BytePairCodec, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Bytes of each text."""
    data = codec.decode(ids)
    sizes = np.concatenate([[0], np.cumsum(codec.token_sizes[ids])])
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(sizes[bounds].astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """`id_col` and `ids` of each text; with `with_bytes` also `decoded`, the bytes of those ids, without a second pass.

    Each match of `pattern` is encoded by itself; special tokens are ordinary text.
    """
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shipped.value)
        for batch in batches:
            for first, _, offsets in text_slices(batch.column(1), OUTPUT_BYTES):
                rows = len(offsets) - 1
                lists, ids, bounds = _encoded(codec, batch.column(1).slice(first, rows))
                columns = [batch.column(0).slice(first, rows), lists]
                yield pa.RecordBatch.from_arrays([*columns, _decoded(codec, ids, bounds)] if with_bytes else columns, names)

    names = [id_col, "ids", "decoded"][: 2 + with_bytes]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * with_bytes)


def decode(tokens: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and `decoded`, the bytes of `ids_col`. Null lists are empty; an unknown or null id fails the job."""
    bounded_batches(tokens.sparkSession)
    shipped = tokens.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, "")
        for batch in batches:
            lists = batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten()
            ids = flat.to_numpy(zero_copy_only=False)
            if flat.null_count or len(ids) and (ids.min() < 0 or ids.max() >= len(codec.token_sizes) or not codec.token_sizes[ids].all()):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column(0), _decoded(codec, ids, bounds)], [id_col, "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, F.col(ids_col).cast("array<int>").alias("_ids")).mapInArrow(work, f"`{id_col}` {kind}, decoded binary")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of encoded documents: `n_tokens`, `ids_sha256`, `decoded_sha256`."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
