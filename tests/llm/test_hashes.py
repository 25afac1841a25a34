"""Words and runs that differ at every place and yet are equal to a polynomial modulo a power of two."""

import numpy as np
from pyspark.sql import functions as F
from test_decontamination import brute as brute_hits
from test_dedup import brute_bytes

from lorespark.llm import arrays, decontamination, lm_scoring, ngram_join, substring_dedup, suffix_dedup

MORSE = "".join("ab"[at.bit_count() % 2] for at in range(1024))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))
BLOCKS = MORSE.replace("a", "x" * 24).replace("b", "y" * 24), MORSE.replace("a", "y" * 24).replace("b", "x" * 24)
SCHEMA = "doc_id long, text string"


def test_regular_runs_have_different_hashes():
    for one, other in ((MORSE, OTHER), BLOCKS):
        values = arrays.byte_values(np.frombuffer((one + other).encode(), np.uint8))
        first, second = arrays.range_hashes(values, np.array([0, len(one)]), np.array([len(one), 2 * len(one)]))
        assert first != second


def test_equal_runs_have_equal_hashes_at_all_places():
    values = np.random.default_rng(3).integers(0, 2**64, 500, dtype=np.uint64)
    whole = np.concatenate([values, values[7:], values])
    hashes = arrays.gram_hashes(whole, 37)
    assert (hashes[:464] == hashes[993 : 993 + 464]).all() and (hashes[7:464] == hashes[500 : 500 + 457]).all() and len(np.unique(hashes[:464])) == 464
    starts = np.arange(464)
    assert (arrays.range_hashes(whole, starts, starts + 37) == hashes[:464]).all()


def test_operators_tell_them_apart(spark):
    docs = spark.createDataFrame([(1, MORSE), (2, OTHER), (3, f"before {MORSE} after"), (4, f"before {OTHER} after")], SCHEMA)
    linked = {row.doc_id: row.component_id for row in ngram_join.link(docs).collect()}
    assert linked == {1: 1, 2: 2, 3: 3, 4: 4}

    items = spark.createDataFrame([(1, MORSE)], "item_id long, text string")
    marked = {row.doc_id: row.n_hit for row in decontamination.digests(decontamination.mark(docs, items)).collect()}
    assert marked == {key: len(hit) for key, _, hit, _ in brute_hits([(1, MORSE), (2, OTHER), (3, f"before {MORSE} after"), (4, f"before {OTHER} after")], [(1, MORSE)])}
    assert marked == {1: 1, 2: 0, 3: 1, 4: 0}

    known = {row.doc_id: row.n_known for row in lm_scoring.score(docs.filter("doc_id < 3"), F.col("doc_id") == 1).collect()}
    assert known == {1: 2, 2: 1}

    words = [f"w{n}" for n in range(60)]
    rows = [(1, " ".join([*words[:30], MORSE, *words[30:]])), (2, " ".join([*words[:30], OTHER, *words[30:]])), (3, " ".join([*words[:30], MORSE, *words[30:]]))]
    removed = {row.doc_id: row.n_removed for row in substring_dedup.digests(substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert removed == {1: 0, 2: 0, 3: 61}

    rows = [(1, MORSE[:300]), (2, "-" + OTHER[:300]), (3, BLOCKS[0][:5000]), (4, "." + BLOCKS[1][:5000])]
    found = {row.doc_id: (row.n_bytes, row.n_removed) for row in suffix_dedup.digests(suffix_dedup.dedup(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found == {key: (size, gone) for key, size, gone, *_ in brute_bytes(rows, 200)}
