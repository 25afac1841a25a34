"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch of texts stand in one ragged array of symbols. In each
round every sequence looks up the ranks of its adjacent pairs and merges all
places of its lowest pair at once; sequences without a pair left retire, and what
remains of them is their count. Only pre-tokens that a worker has not counted
before enter the array.

The vocabulary is a `tokenizers` JSON file of this family: composed and
lower-cased text, pieces by a pattern, byte symbols, an end-of-word suffix. The
added special strings count one token each wherever they stand in a text. A file
of another family raises ValueError.

Defined cases: null text is empty text (0 bytes, 0 tokens); rows are kept one to
one, repeated rows and null ids included; columns other than the id and the text
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrays import bounded_batches, kept_model, text_slices

MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens whose counts a worker remembers.
REMEMBERED_PIECES = 250_000
#: Bytes of text whose pre-tokens are merged together.
BATCH_BYTES = 1 << 20


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY_BYTES} characters")
    return content


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [value for value in range(256) if value not in set(visible)]
    characters = {value: chr(value) for value in visible} | {value: chr(0x100 + place) for place, value in enumerate(hidden)}
    return [characters[value] for value in range(256)]


class MergeCounter:
    """Counts tokens of pieces by one vocabulary."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        split = [step for step in spec["pre_tokenizer"]["pretokenizers"] if step["type"] == "Split"]
        kinds = [step["type"] for step in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or len(split) != 1 or not split[0]["invert"]:
            raise ValueError("not a vocabulary of lower-cased words with an end-of-word suffix")
        if any(token["normalized"] or token["lstrip"] or token["rstrip"] or token["single_word"] for token in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        special = sorted((token["content"] for token in spec["added_tokens"]), key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.special = special
        self.find_pieces = regex.compile(split[0]["pattern"]["Regex"]).findall
        vocabulary = model["vocab"]
        letters = byte_characters()
        self.inner = np.array([vocabulary[letter] for letter in letters], np.int64)
        self.final = np.array([vocabulary[letter + suffix] for letter in letters], np.int64)
        self.size = max(vocabulary.values()) + 1
        merges = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
        keys = np.array([vocabulary[left] * self.size + vocabulary[right] for left, right in merges], np.int64)
        made = np.array([vocabulary[left + right] for left, right in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks, self.made = keys[order], order.astype(np.int64), made
        self.known: dict[str, int] = {}

    def pair_ranks(self, symbols: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its right neighbour; the number of merges where there is none."""
        wanted = symbols[:-1] * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.key_ranks[at], len(self.made))

    def merged_sizes(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that the merges leave of each non-empty piece."""
        sizes = np.array([len(piece) for piece in pieces], np.int64)
        left_over = sizes.copy()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        none = len(self.made)
        while len(symbols) > 1:
            ranks = np.where(owner[:-1] == owner[1:], self.pair_ranks(symbols), none)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(np.append(ranks, none), starts)
            by_symbol = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            hit = np.append(ranks, none) == by_symbol
            hit &= by_symbol < none
            # Of places side by side (one symbol repeated) every second one merges, from the left.
            places = np.flatnonzero(hit)
            if not len(places):
                break
            head = np.concatenate([[True], np.diff(places) != 1])
            run_start = places[head][np.cumsum(head) - 1]
            places = places[(places - run_start) % 2 == 0]
            symbols[places] = self.made[by_symbol[places]]
            keep = by_symbol < none  # sequences without a pair retire
            keep[places + 1] = False
            left_over -= np.bincount(owner[places], minlength=len(pieces))
            symbols, owner = symbols[keep], owner[keep]
        return left_over

    def pieces_of(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and how many special strings it holds."""
        if any(token in text for token in self.special):
            parts = self.find_special.split(text)
            return [piece for part in parts for piece in self.pieces_of_plain(part)], len(parts) - 1
        return self.pieces_of_plain(text), 0

    def pieces_of_plain(self, text: str) -> list[str]:
        # Lower case letter by letter: a final sigma is like any other.
        return self.find_pieces(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        pieces: list[str] = []
        bounds, special = [0], []
        for text in texts:
            found, others = self.pieces_of(text)
            pieces += found
            bounds.append(len(pieces))
            special.append(others)
        new = list(set(pieces) - self.known.keys())
        sizes = dict(zip(new, self.merged_sizes([piece.encode() for piece in new]).tolist())) if new else {}
        if len(self.known) + len(sizes) <= REMEMBERED_PIECES:
            self.known.update(sizes)
            lookup = self.known.__getitem__
        else:
            known = self.known.get
            lookup = lambda piece: known(piece) or sizes[piece]  # noqa: E731  full: what is new serves this batch only
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(lookup, pieces), np.int64, len(pieces)))])
        return sums[bounds[1:]] - sums[bounds[:-1]] + np.array(special, np.int64)


def _counter(content: str) -> MergeCounter:
    return kept_model(content, lambda: MergeCounter(content))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `n_bytes` (UTF-8) and `n_tokens` of every row."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shipped.value)
        for batch in batches:
            for first, _, offsets in text_slices(batch.column(1), BATCH_BYTES):
                rows = len(offsets) - 1
                texts = batch.column(1).slice(first, rows).fill_null("").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(np.diff(offsets)), pa.array(counter.count(texts))], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(work, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
