"""Language-model scores by deleted interpolation.

The probability of a token given the one before is a mixture of three
estimates: the bigram's and the unigram's relative frequency and a uniform share.
The weights depend on how often the context was seen (one set for each power of
two). Expectation-maximisation learns them on held-out counts: every training
token is held out in turn, that is, its own occurrence is taken off the counts.

Counts are exact and stay distributed:

1. Texts are packed into blocks of some megabytes and written.
2. Each block sends its different words and bigrams, as sorted hashes with their
   training counts, to shards of the hash range, so that a frequent word costs a
   block one entry. A shard adds up and answers each block in the same order.
3. The answers meet their block again. Training tokens are counted by (context
   class, estimates to an eighth of a power of two): a table of bounded size, all
   that the driver sees, on which the weights are learned. The block is written
   with its counts, and a last pass without a shuffle forms the scores from the
   exact counts.

Tokens are words, A-Z lower-cased, and one end for each text. Words and bigrams
are told apart by 56 bits of a hash.

Defined cases: null and empty texts have the end token only; rows without an id
are scored and not learned from; rows are kept one to one; without training rows
every token has probability one; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrays import SPACED, bounded_batches, byte_values, class_table, drop_model, mix, range_hashes, text_slices, word_spans
from lorespark.session import written

BLOCK_BYTES = 8 << 20
#: Bytes of text for which one shard is made.
SHARD_BYTES = 12 << 20
HASH_BITS = 56
_TABLE = class_table(SPACED, lower=True)
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LEFT = np.uint64(0x2545F4914F6CDD1D)
#: Estimates are counted to this part of a power of two when the weights are learned.
STEPS = 8
NEVER = -(1 << 20)
ROUNDS = 60
LEAST_WEIGHT = 1e-7

_PLANES = "little"


def pack_numbers(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes."""
    planes = np.asarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    return zstandard.ZstdCompressor(level=1).compress(bytes([used]) + len(values).to_bytes(8, _PLANES) + planes[:used].tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(packed)
    used, size = data[0], int.from_bytes(data[1:9], _PLANES)
    planes = np.zeros((size, 8), np.uint8)
    planes[:, :used] = np.frombuffer(data, np.uint8, used * size, 9).reshape(used, size).T
    return planes.view("<u8").ravel().astype(np.uint64)


@dataclass
class Tokens:
    """Tokens of a block: hash of each token and of each bigram, whether it is a text's end or begins a text, texts' bounds."""

    word: np.ndarray
    bigram: np.ndarray
    is_end: np.ndarray
    is_start: np.ndarray
    bounds: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    words, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)])
    for _, part, places in text_slices(texts):
        mapped = _TABLE[part]
        starts, ends, bounds = word_spans(mapped, places)
        words.append(range_hashes(byte_values(mapped), starts, ends))
        counts.append(np.diff(bounds))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts) + 1)])
    is_end = np.zeros(bounds[-1], np.bool_)
    is_end[bounds[1:] - 1] = True
    is_start = np.zeros(bounds[-1], np.bool_)
    is_start[bounds[:-1]] = True
    token = np.full(bounds[-1], _END)
    token[~is_end] = np.concatenate(words)
    context = np.concatenate([[_START], token[:-1]])[: len(token)]
    context[is_start] = _START
    shift = np.uint64(64 - HASH_BITS)
    return Tokens(token >> shift, mix(context * _LEFT + token) >> shift, is_end, is_start, bounds)


def shard_edges(shards: int) -> np.ndarray:
    """First hash of each shard."""
    return np.array([-(-(number << HASH_BITS) // shards) for number in range(shards)], np.uint64)


def _text_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), np.uint8)
    return data, np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)


def _different(tokens: Tokens) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(sorted different hashes, number of each place among them) for words and for bigrams; ends are no words here."""
    return np.unique(tokens.word[~tokens.is_end], return_inverse=True), np.unique(tokens.bigram, return_inverse=True)


BLOCK = "block string, ids array<bigint>, train array<boolean>, sizes array<bigint>, packed binary"


def pack(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """Blocks of texts."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        ids, train, texts = [list(column) for column in zip(*rows)]
        packed = zstandard.ZstdCompressor(level=5).compress(b"".join(texts))
        columns = [[uuid.uuid4().hex], [ids], [train], [[len(text) for text in texts]], [packed]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], ["block", "ids", "train", "sizes", "packed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        rows, size = [], 0
        for batch in batches:
            for key, train, text in zip(*[column.to_pylist() for column in batch.columns]):
                data = (text or "").encode()
                if rows and size + len(data) > BLOCK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
                rows.append((key, train, data))
                size += len(data)
        if rows:
            yield block(rows)

    learned = F.coalesce(learn, F.lit(False)) & F.col(id_col).isNotNull()
    return docs.select(F.col(id_col).cast("long").alias("id"), learned.alias("train"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, BLOCK)


def requests(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, hashes, counts): each block's different words (shards from 0) and bigrams (from `shards`) with training counts."""
    edges = shard_edges(shards)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            for row in batch.to_pylist():
                tokens = tokens_of(*_text_of(row))
                train = np.repeat(np.array(row["train"], np.bool_), np.diff(tokens.bounds))
                (words, word_at), (bigrams, bigram_at) = _different(tokens)
                columns: list[list] = [[], [], [], []]
                for kind, hashes, places, learned in ((0, words, word_at, train[~tokens.is_end]), (1, bigrams, bigram_at, train)):
                    counts = np.bincount(places[learned], minlength=len(hashes))
                    cuts = np.append(np.searchsorted(hashes, edges), len(hashes)).tolist()
                    for shard, (low, high) in enumerate(zip(cuts, cuts[1:])):
                        if high > low:
                            deltas = np.diff(hashes[low:high], prepend=np.uint64(0))
                            for column, value in zip(columns, (row["block"], kind * shards + shard, pack_numbers(deltas), pack_numbers(counts[low:high]))):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["block", "shard", "hashes", "counts"])

    return blocks.mapInArrow(work, "block string, shard int, hashes binary, counts binary")


def answers(asked: DataFrame, shards: int) -> DataFrame:
    """(block, shard, counts): counts over all training texts in the order of the request; a row without a block sums up a shard of words."""

    def work(table: pa.Table) -> pa.Table:
        drop_model()
        shard = table.column("shard")[0].as_py()
        hashes = [np.cumsum(unpack_numbers(packed), dtype=np.uint64) for packed in table.column("hashes").to_pylist()]
        different, places = np.unique(np.concatenate(hashes), return_inverse=True)
        parts = [unpack_numbers(packed).astype(np.int64) for packed in table.column("counts").to_pylist()]
        totals = np.bincount(places, weights=np.concatenate(parts), minlength=len(different)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, hashes)]).tolist()
        packed = [pack_numbers(totals[places[low:high]]) for low, high in zip(cuts, cuts[1:])]
        blocks = table.column("block").to_pylist()
        sums = [None] * len(blocks), [None] * len(blocks)
        if shard < shards:
            blocks, packed, sums = [*blocks, None], [*packed, None], ([*sums[0], int(totals.sum())], [*sums[1], int((totals > 0).sum())])
        columns = [pa.array(blocks, pa.string()), pa.array([shard] * len(blocks), pa.int32()), pa.array(packed, pa.binary()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())]
        return pa.Table.from_arrays(columns, ["block", "shard", "counts", "total", "different"])

    return asked.groupBy("shard").applyInArrow(work, "block string, shard int, counts binary, total long, different long")


@dataclass(frozen=True)
class Corpus:
    """Training tokens, different ones, and training texts; the end token is counted."""

    tokens: int
    different: int
    texts: int


@dataclass
class Counted:
    """Counts of each token of a block: its context, itself and both together."""

    context: np.ndarray
    token: np.ndarray
    bigram: np.ndarray
    bounds: np.ndarray


def counted(row: dict, corpus: Corpus) -> Counted:
    tokens = tokens_of(*_text_of(row))
    (_, word_at), (_, bigram_at) = _different(tokens)
    token = np.full(len(tokens.word), corpus.texts, np.int64)
    token[~tokens.is_end] = unpack_numbers(row["words"]).astype(np.int64)[word_at]
    context = np.concatenate([[corpus.texts], token[:-1]])[: len(token)]
    context[tokens.is_start] = corpus.texts
    return Counted(context, token, unpack_numbers(row["bigrams"]).astype(np.int64)[bigram_at], tokens.bounds)


def context_class(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one class for each power of two."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(np.float64))[1], 0)


def _ratio(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    return np.where(part > 0, part / np.maximum(whole, 1), 0.0)


def _steps(probabilities: np.ndarray) -> np.ndarray:
    return np.where(probabilities > 0, np.round(np.log2(np.where(probabilities > 0, probabilities, 1)) * STEPS), NEVER).astype(np.int64)


def held_out_cells(counts: Counted, train: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """(cells: context class, bigram estimate, unigram estimate; how many training tokens are in each), every token left out of its own counts."""
    context, token, bigram = counts.context[train] - 1, counts.token[train] - 1, counts.bigram[train] - 1
    return np.unique(np.stack([context_class(context), _steps(_ratio(bigram, context)), _steps(_ratio(token, corpus.tokens - 1))]), axis=1, return_counts=True)


def joined(blocks: DataFrame, answered: DataFrame, corpus: Corpus, shards: int) -> DataFrame:
    """Blocks with their counts and the cells of their training tokens."""
    schema = f"{BLOCK}, words binary, bigrams binary, cells array<array<bigint>>"
    both = blocks.withColumns({"shard": F.lit(-1), "counts": F.lit(None).cast("binary")}).unionByName(answered.filter("block is not null").select("block", "shard", "counts"), allowMissingColumns=True)

    def work(table: pa.Table) -> pa.Table:
        drop_model()
        order = np.argsort(table.column("shard").to_numpy())
        shard = table.column("shard").to_numpy()[order]
        row = table.slice(int(order[0]), 1).to_pylist()[0]
        packed = table.column("counts")
        pieces = [(kind, unpack_numbers(packed[int(at)].as_py())) for kind, at in zip((shard[1:] >= shards).tolist(), order[1:])]
        for name, wanted in (("words", False), ("bigrams", True)):
            row[name] = pack_numbers(np.concatenate([np.empty(0, np.uint64), *[numbers for kind, numbers in pieces if kind == wanted]]))
        counts = counted(row, corpus)
        train = np.repeat(np.array(row["train"], np.bool_), np.diff(counts.bounds))
        cells, times = held_out_cells(counts, train, corpus)
        row["cells"] = np.concatenate([cells, times[None]]).T.tolist()
        columns = {name: [row[name]] for name in out.names}
        return pa.Table.from_pydict(columns, schema=out)

    numbers = pa.list_(pa.int64())
    out = pa.schema([("block", pa.string()), ("ids", numbers), ("train", pa.list_(pa.bool_())), ("sizes", numbers), ("packed", pa.binary()), ("words", pa.binary()), ("bigrams", pa.binary()), ("cells", pa.list_(numbers))])
    return both.groupBy("block").applyInArrow(work, schema)


def learned_weights(cells: np.ndarray, times: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate for each context class."""
    weights = np.tile([0.0, 0.0, 1.0], (65, 1))
    if not len(times):
        return weights
    chances = np.stack([np.where(row > NEVER, np.exp2(row / STEPS), 0.0) for row in (cells[1], cells[2])] + [np.full(len(times), 1 / (corpus.different + 1))])
    for group in [None, *np.unique(cells[0]).tolist()]:
        own = np.ones(len(times), np.bool_) if group is None else cells[0] == group
        usable = np.array([group != 0, True, True])
        mixture = usable / usable.sum()
        for _ in range(ROUNDS):
            shares = mixture[:, None] * chances[:, own]
            mixture = np.maximum((shares / shares.sum(axis=0) * times[own]).sum(axis=1), LEAST_WEIGHT * times[own].sum()) * usable
            mixture /= mixture.sum()
        weights[slice(None) if group is None else group] = mixture
    # Contexts never seen have no bigram estimate; without any of them to learn from, the general weights are shared out.
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def token_logs(counts: Counted, weights: np.ndarray, corpus: Corpus) -> np.ndarray:
    """log10 probability of each token."""
    own = weights[context_class(counts.context)]
    return np.log10(own[:, 0] * _ratio(counts.bigram, counts.context) + own[:, 1] * _ratio(counts.token, corpus.tokens) + own[:, 2] / (corpus.different + 1))


def base_logs(token: np.ndarray, corpus: Corpus) -> np.ndarray:
    return np.log10((token + 0.1) / (corpus.tokens + 0.1 * (corpus.different + 1)))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `learned_from`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` of every row.

    `learn` says which rows are training texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = written(pack(docs, learn, id_col, text_col))
    size, texts = blocks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("size"), F.size(F.filter("train", lambda x: x)).cast("long").alias("texts")).agg(F.sum("size"), F.sum("texts")).first()
    shards = max(4, -(-(size or 0) // SHARD_BYTES))
    answered = written(answers(requests(blocks, shards), shards))
    words, different = answered.filter("block is null").agg(F.sum("total"), F.sum("different")).first()
    texts = texts or 0
    corpus = Corpus((words or 0) + texts, (different or 0) + (texts > 0), texts)

    ready = written(joined(blocks, answered, corpus, shards))
    cells = ready.select(F.explode("cells").alias("cell")).groupBy(*[F.col("cell")[at].alias(f"c{at}") for at in range(3)]).agg(F.sum(F.col("cell")[3]).alias("times")).toArrow()
    weights = learned_weights(np.stack([cells[f"c{at}"].to_numpy() for at in range(3)]), cells["times"].to_numpy(), corpus)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            for row in batch.to_pylist():
                counts = counted(row, corpus)
                first = counts.bounds[:-1]
                columns = [
                    pa.array(row["ids"], pa.int64()), pa.array(row["train"], pa.bool_()), pa.array(np.diff(counts.bounds)), pa.array(np.add.reduceat((counts.token > 0).astype(np.int64), first)),
                    pa.array([corpus.tokens] * len(first), pa.int64()), pa.array(np.add.reduceat(base_logs(counts.token, corpus), first)), pa.array(np.add.reduceat(token_logs(counts, weights, corpus), first)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "learned_from", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return ready.drop("cells").mapInArrow(work, f"`{id_col}` long, learned_from boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
