import math
import random
from decimal import Decimal

import numpy as np
import pytest

from lorespark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, deviation string"


def integers(rows, dimensions):
    usable = [(key, v) for key, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    return [key for key, _ in usable], np.array([[math.floor(1024 * x) for x in v] + [0] * (dimensions - len(v)) for _, v in usable], object)


def polynomial(matrix):
    """det(x - matrix) by the trace recursion in whole numbers, from the constant on."""
    size = len(matrix)
    coefficients, m = [1], np.zeros((size, size), object)
    unit = np.eye(size, dtype=int).astype(object)
    for k in range(1, size + 1):
        m = matrix @ m + coefficients[-1] * unit
        coefficients.append(-sum((matrix @ m)[i, i] for i in range(size)) // k)
    return coefficients[::-1]


def checked(spark, rows, dimensions):
    keys, y = integers(rows, dimensions)
    frame = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit(frame)
    result = [row.asDict() for row in whitening.component_rows(frame, model).collect()]
    n, sums = len(keys), y.sum(axis=0)
    covariance = np.cov(y.astype(float).T, bias=True).reshape(dimensions, dimensions)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviations = sorted(int(((n * row - sums) ** 2).sum()) for row in y)
    components = len(model.variances)
    assert len(result) == n * components and {row["component"] for row in result} == set(range(1, components + 1))
    assert sorted(row["deviation"] for row in result if row["component"] == 1) == deviations
    assert all(row["n"] == n and abs(row["identity_error"]) < 1e-9 for row in result)
    np.testing.assert_allclose(model.variances, values[:components], rtol=1e-9)
    np.testing.assert_allclose(model.explained, values[:components] / values.sum(), rtol=1e-9)
    return model, values, vectors, result, keys, y


def test_against_the_eigenvectors_of_the_covariance(spark):
    chance = random.Random(3)
    rows = [(n % 290, [chance.gauss(0, 1) * 2.0 ** -(d / 3) + (chance.random() if d else 0) for d in range(12)], "x") for n in range(300)]
    rows += [(900, None, ""), (901, [], ""), (902, [1.0, None] + [0.0] * 10, ""), (903, [math.nan] * 12, ""), (904, [math.inf] * 12, ""), (None, [0.5] * 12, ""), (905, [2.0, 1.0], "short")]
    model, values, vectors, result, keys, y = checked(spark, rows, 12)
    assert len(model.variances) == 8
    signs = np.sign((vectors[:, :8] * model.vectors).sum(axis=0))
    np.testing.assert_allclose(vectors[:, :8] * signs, model.vectors, atol=1e-9)
    projected = (y.astype(float) - y.astype(float).mean(axis=0)) @ model.vectors / np.sqrt(model.variances)
    for component in range(8):
        mine = sorted((row["vec_id"] or -1, row["whitened"]) for row in result if row["component"] == component + 1)
        wanted = sorted((key or -1, value) for key, value in zip(keys, projected[:, component]))
        np.testing.assert_allclose([v for _, v in mine], [v for _, v in wanted], atol=1e-9)


def test_equal_and_missing_variances(spark):
    cross = [(n, [float(v) for v in row], "") for n, row in enumerate(np.vstack([np.eye(5), -np.eye(5)]) * [2, 2, 2, 1, 0])]
    model, *_ = checked(spark, cross, 5)
    assert len(model.variances) == 4  # the last one never varies
    np.testing.assert_allclose(model.vectors.T @ model.vectors, np.eye(4), atol=1e-14)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0], "")], [(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], [(1, None, "")]):
        frame = spark.createDataFrame(rows, SCHEMA)
        out = whitening.component_rows(frame, whitening.fit(frame))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_components_are_exact_or_refused(spark):
    rows = [(n, [2.0**40 * (n + 1), 1.0 - n], "") for n in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    _, y = integers(rows, 2)
    wanted = [int(((3 * row - y.sum(axis=0)) ** 2).sum()) for row in y]
    assert sorted(int(row.deviation) for row in whitening.transform(frame, whitening.fit(frame)).collect()) == sorted(wanted)
    with pytest.raises(Exception, match="too large"):
        whitening.fit(spark.createDataFrame([(1, [1e300], "")], SCHEMA))


def test_polynomial_through_primes(spark):
    chance = random.Random(5)
    for size in (1, 2, 3, 7):
        half = np.array([[chance.randrange(-(10**6), 10**6) for _ in range(size)] for _ in range(size)], object)
        if size == 7:
            half[2] = half[3]  # one root is zero
        matrix = half @ half.T
        assert whitening.characteristic_polynomial(spark, matrix) == polynomial(matrix)
    # Zeros below the diagonal ask for exchanges of rows.
    matrix = np.array([[2, 0, 1, 0], [0, 3, 0, 1], [1, 0, 2, 0], [0, 1, 0, 5]], object)
    assert whitening.characteristic_polynomial(spark, matrix) == polynomial(matrix)


def test_roots_are_enclosed():
    # (x - 1)(x - 4)^2 x and a root between whole numbers
    assert [m / 2**s for m, s in whitening.largest_roots([0, -16, 24, -9, 1], 8)] == [4, 4, 1]
    (m, s), (low, t) = whitening.largest_roots([1, -3, 1], 2)
    golden = (Decimal(3) + Decimal(5).sqrt()) / 2
    assert abs(Decimal(m) / 2**s - golden) < Decimal("1e-26") and m.bit_length() >= whitening.ROOT_BITS and low.bit_length() >= whitening.ROOT_BITS
    assert whitening.roots_beyond([0, -16, 24, -9, 1], 3) == 2 and whitening.roots_beyond([0, -16, 24, -9, 1], 4) == 0
