import math
import random

import pytest
from pyspark.sql import functions as F

from lorespark.llm import topk_search

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k=5):
    usable = {}
    for key, vector, _ in rows:
        if key is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            usable.setdefault(key, []).append([math.floor(256 * x) for x in vector])
    out = []
    for query, forms in usable.items():
        if query % 50 == 0:
            best = sorted((-max(sum(a * b for a, b in zip(min(forms), other)) for other in others), key) for key, others in usable.items() if key != query)
            out += [(query, rank, key, -score) for rank, (score, key) in enumerate(best[:k], 1)]
    return sorted(out)


def result(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, topk_search.search(frame, F.col("vec_id") % 50 == 0, **more).collect()))


def test_against_brute_force(spark):
    chance = random.Random(1)
    scales = [1, 1, 1, 3, 0.1]
    rows = [(n, [chance.gauss(0.2, 1) * 2 ** -(d // 3) * chance.choice(scales) for d in range(12)], "x") for n in range(700)]
    rows += [(n, [0.5, 0.25] + [0.0] * 10, "tie") for n in range(800, 900)] + [(900, [0.0] * 12, "zero"), (901, None, ""), (902, [], ""), (950, [1.0, None] + [0.0] * 10, "")]
    rows += [(1000, [math.nan] * 12, ""), (1001, [math.inf] * 12, ""), (1002, [1e9] * 12, ""), (None, [9.0] * 12, ""), (5, rows[5][1], "again"), (50, rows[50][1], "again"), (1050, [1.0, 2.0], "short")]
    wanted = brute(rows)
    assert result(spark, rows) == wanted
    assert result(spark, rows, block_bytes=400) == wanted


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.5, 0.0], ""), (50, [-1.0, 2.0], "")]
    assert result(spark, rows) == brute(rows) and len(brute(rows)) == 4
    assert result(spark, []) == []
    assert result(spark, [(1, [1.0], "")]) == []
    assert result(spark, [(0, [1.0], "")]) == []


def test_finite_vectors_of_any_size_take_part(spark):
    chance = random.Random(8)
    rows = [(n * 10, [600000.0 * chance.choice((1, -1)), chance.random(), 2.0**40 if n == 7 else 0.0], "") for n in range(40)]
    assert result(spark, rows) == brute(rows)
    # Sums of products close to 2**63, as Python adds them.
    rows = [(n, [float(2**18 - 1 - n)] * 1024 + [float(n)], "") for n in range(3)] + [(50, [-float(2**18)] * 1025, "")]
    assert result(spark, rows) == brute(rows) and max(abs(x[3]) for x in brute(rows)) > 2**61
    # A large component that meets zeros only.
    rows = [(0, [1e30, 0.0], ""), (1, [0.0, 3.0], ""), (50, [0.0, 1e9], ""), (3, [1e-30, 1.0], "")]
    assert result(spark, rows) == brute(rows)


def test_scores_beyond_a_long_are_refused(spark):
    for first in (1.0, -1.0):
        with pytest.raises(Exception, match="does not fit"):
            result(spark, [(0, [float(2**19 - 1)] * 1024, ""), (1, [first * (2**19 - 1)] * 1024, "")])
