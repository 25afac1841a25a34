import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import lm_scoring
from lorespark.llm.queries import op2_lm_scoring

SCHEMA = "doc_id long, text string, score string, train int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    """The same model word by word."""

    def __init__(self, texts):
        self.single, self.pair, self.context = Counter(), Counter(), Counter()
        self.rows = []
        for text in texts:
            row = ["<s>", *words_of(text), "</s>"]
            self.rows.append(row)
            self.single.update(row[1:])
            self.pair.update(zip(row, row[1:]))
            self.context.update(row[:-1])
        self.n, self.v = self.single.total(), len(self.single)
        cells = Counter()
        for row in self.rows:
            for left, right in zip(row, row[1:]):
                c, b, s = self.context[left] - 1, self.pair[left, right] - 1, self.single[right] - 1
                step = lambda p: round(math.log2(p) * lm_scoring.STEPS) if p > 0 else lm_scoring.NEVER
                cells[c.bit_length(), step(b / c if b else 0), step(s / (self.n - 1) if s else 0)] += 1
        keys = np.array(list(cells)).T if cells else np.empty((3, 0), int)
        self.corpus = lm_scoring.Corpus(self.n, self.v, len(texts))
        self.weights = lm_scoring.learned_weights(keys, np.array(list(cells.values())), self.corpus)

    def scores(self, text):
        row = ["<s>", *words_of(text), "</s>"]
        base = sum(math.log10((self.single[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in row[1:])
        total = 0.0
        for left, right in zip(row, row[1:]):
            a, b, c = self.weights[self.context[left].bit_length()]
            total += math.log10(a * (self.pair[left, right] / self.context[left] if self.pair[left, right] else 0) + b * self.single[right] / max(self.n, 1) + c / (self.v + 1))
        return len(row) - 1, sum(self.single[w] > 0 for w in row[1:]), self.n, base, total


ROWS = [(1, "the cat sat on the mat", 1), (2, "The cat\tsat on\nthe hat", 1), (3, None, 1), (4, "", 1), (5, "the dog sat", 0), (6, None, 0), (7, "unseen words é only", 0), (8, "the cat sat on the mat", 1), (8, "the cat sat on the mat", 1), (None, "the cat", 1), (9, "x " * 3000, 1)]


@pytest.mark.parametrize("block", [lm_scoring.BLOCK_BYTES, 60])
def test_against_the_plain_model(spark, block, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    frame = spark.createDataFrame([(key, text, "clash", train) for key, text, train in ROWS], SCHEMA)
    found = lm_scoring.score(frame, F.col("train") == 1).collect()
    plain = Plain([text for key, text, train in ROWS if train and key is not None])
    assert len(found) == len(ROWS)
    for row in found:
        text, train = next((text, train) for key, text, train in ROWS if key == row.doc_id)
        n, known, total, base, score = plain.scores(text)
        assert (row.learned_from, row.n_tokens, row.n_known, row.train_tokens) == (bool(train) and row.doc_id is not None, n, known, total)
        assert math.isclose(row.base_score, base, rel_tol=1e-9) and math.isclose(row.score, score, rel_tol=1e-9)


def test_numbers_are_packed_and_unpacked():
    for numbers in ([], [0], [0, 0, 5], [2**56 - 1, 0, 3], list(range(1000))):
        assert lm_scoring.unpack_numbers(lm_scoring.pack_numbers(np.array(numbers, np.uint64))).tolist() == numbers


def test_weights_follow_the_data():
    corpus = lm_scoring.Corpus(1000, 99, 10)
    # In class 3 the bigram is always right, in class 1 never.
    cells = np.array([[3, 1], [0, lm_scoring.NEVER], [-40, -24]])
    weights = lm_scoring.learned_weights(cells, np.array([500, 500]), corpus)
    assert weights[3, 0] > 0.95 and weights[1, 0] < 0.01 and np.allclose(weights.sum(axis=1), 1)


def test_nothing_to_learn_from_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA)
    (row,) = lm_scoring.score(frame, F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_held_out_documents_of_a_table(spark):
    folder = "/root/testdata/sf0.001"
    documents = {row.doc_id: row.text for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = lambda key: zlib.crc32(str(key).encode()) % 10 == 0
    plain = Plain([text for key, text in documents.items() if not held(key)])
    found = op2_lm_scoring(spark, folder).collect()
    assert len(found) == len(documents)
    for row in found:
        n, known, total, base, score = plain.scores(documents[row.doc_id])
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held(row.doc_id), n, known, total)
        assert math.isclose(row.base_score, base, rel_tol=1e-9) and math.isclose(row.score, score, rel_tol=1e-6)
    out = [row for row in found if row.held_out]
    assert sum(row.score for row in out) > sum(row.base_score for row in out)
