"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Vectors become integers, y = floor(scale * x). Their count, sums and products are
added up exactly in Spark and give the integer matrix M = n * sum(y y') - s s',
which is n**2 times the covariance. Tasks reduce M to Hessenberg form modulo one
prime each and send back the residues of its characteristic polynomial; Chinese
remaindering makes them whole. All roots of the polynomial are real, so the sign
changes of its shifted coefficients count the roots beyond a point without error,
and bisection encloses every root as narrowly as wanted. A component is the null
vector of M - root, found by inverse iteration with 80 decimal digits. Rows are
then projected task by task.

What the driver holds is bounded by the dimensions (at most MAX_DIMENSIONS), never
by the rows.

Defined cases: a vector that is null, empty, or holds null or non-finite
components takes no part and gives no row; a missing last component counts as
zero; repeated rows and rows without an id count and are returned like any other;
components of variance zero (all of them for a single vector or equal ones) can't
be scaled and give no rows; equal variances give any orthogonal vectors of their
space; extra columns are ignored; an empty table gives an empty result. A
component that does not fit 62 bits after scaling raises ArithmeticError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.arrays import bounded_batches, drop_model

#: Beyond this the polynomial's own size (dimensions squared times some 50 bits) is refused.
MAX_DIMENSIONS = 1024
#: Integers of the scaled vectors have fewer bits.
COMPONENT_BITS = 62
#: Decimal digits of the inverse iteration.
DIGITS = 80
#: Bits to which a root is enclosed, counted from its own first bit.
ROOT_BITS = 110
#: Primes that one task reduces the matrix by.
PRIMES_PER_TASK = 8


@dataclass(frozen=True)
class Whitening:
    count: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # dimension x component, unit length
    variances: np.ndarray  # of the components, falling
    explained: np.ndarray  # shares of all variance


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """`id` and the integer vector `y` of the rows that take part."""
    limit = float(1 << COMPONENT_BITS)
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(vector_col, lambda x: F.floor(F.when(F.abs(x.cast("double") * float(scale)) < limit, x.cast("double") * float(scale)).otherwise(F.raise_error(F.lit("a component of a vector is too large")).cast("double"))))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), scaled.alias("y"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """A list column as rows of `dimensions` integers, filled up with zeros."""
    out = np.zeros((len(column), dimensions), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out[np.arange(dimensions) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y without rounding: in doubles where they hold it, else in 64 bits, else in Python's integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        part = y.astype(np.float64)
        return (part.T @ part).astype(np.int64)
    if most * most * len(y) < 1 << 63:
        return y.T @ y
    part = y.astype(object)
    return part.T @ part


def exact_sums(rows: DataFrame, dimensions: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and products (an upper triangle) of all rows."""
    upper = np.triu_indices(dimensions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        count, sums, products = 0, np.zeros(dimensions, object), np.zeros(len(upper[0]), object)
        for batch in batches:
            y = matrix(batch.column(0), dimensions)
            count += len(y)
            sums = sums + (y.sum(axis=0) if np.abs(y).max(initial=0) < 1 << 40 else y.astype(object).sum(axis=0))
            products = products + exact_products(y)[upper]
        values = [count, *sums.tolist(), *products.tolist()] if count else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(x) for x in values], pa.decimal128(38, 0))], ["cell", "value"])

    total = rows.select("y").mapInArrow(work, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    summed = dict(zip(total["cell"].to_pylist(), total["value"].to_pylist()))
    whole = [int(summed.get(cell, 0)) for cell in range(1 + dimensions + len(upper[0]))]
    products = np.zeros((dimensions, dimensions), object)
    products[upper] = whole[1 + dimensions :]
    products.T[upper] = whole[1 + dimensions :]
    return whole[0], whole[1 : 1 + dimensions], products


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide all n below 3,215,031,751."""
    if n % 2 == 0:
        return n == 2
    odd = n - 1
    twos = (odd & -odd).bit_length() - 1
    odd >>= twos
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes from 2**31 downwards whose product has more than `bits` bits."""
    found, product, n = [], 1, 2**31 - 1
    while product.bit_length() <= bits:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def modular_polynomials(m: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - m), from the constant on, modulo each prime: a row for each.

    The Hessenberg form is made for all primes at once; products of residues below
    2**31 fit 64 bits.
    """
    size, p = len(m), primes.astype(np.int64)
    h = np.array([[[int(x) % int(q) for x in row] for row in m] for q in primes], np.int64).reshape(len(p), size, size)
    for k in range(size - 2):
        first = np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        for at in np.flatnonzero(first):
            other = k + 1 + first[at]
            h[at, [k + 1, other]] = h[at, [other, k + 1]]
            h[at][:, [k + 1, other]] = h[at][:, [other, k + 1]]
        inverse = np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(h[:, k + 1, k], primes)], np.int64)
        factors = h[:, k + 2 :, k] * inverse[:, None] % p[:, None]
        h[:, k + 2 :, k:] = (h[:, k + 2 :, k:] - factors[:, :, None] * h[:, k + 1, None, k:]) % p[:, None, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * factors[:, None, :] % p[:, None, None]).sum(axis=2)) % p[:, None]
    # The polynomial of every leading block from those of the smaller blocks.
    leading = np.zeros((size + 1, len(p), size + 1), np.int64)
    leading[0, :, 0] = 1
    for k in range(size):
        total = -h[:, k, k, None] * leading[k] % p[:, None]
        total[:, 1:] += leading[k, :, :-1]
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p
            total -= (h[:, i, k] * below % p)[:, None] * leading[i] % p[:, None]
        leading[k + 1] = total % p[:, None]
    return leading[size]


def remaindered(residues: np.ndarray, primes: list[int]) -> list[int]:
    """The integers nearest to zero with these residues (rows: primes)."""
    product = math.prod(primes)
    parts = [(product // q) * pow(product // q, -1, q) for q in primes]
    whole = [sum(part * int(r) for part, r in zip(parts, column)) % product for column in residues.T]
    return [x - product if 2 * x > product else x for x in whole]


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of det(x - m) for a symmetric integer matrix without negative roots, from the constant on."""
    size, trace = len(m), int(sum(m[i, i] for i in range(len(m))))
    # The k-th coefficient is at most C(size, k) * (trace / size)**k, so all are below (1 + trace / size)**size.
    primes = primes_for(size * (trace // size + 2).bit_length() + 2)
    shipped = spark.sparkContext.broadcast(m)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), PRIMES_PER_TASK):
                some = own[at : at + PRIMES_PER_TASK]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(modular_polynomials(shipped.value, some).tolist(), pa.list_(pa.int64()))], ["prime", "residues"])

    tasks = -(-len(primes) // PRIMES_PER_TASK)
    numbered = spark.createDataFrame(list(enumerate(primes)), "place int, prime long").repartitionByRange(tasks, "place")
    found = {row.prime: row.residues for row in numbered.select("prime").mapInArrow(work, "prime long, residues array<long>").collect()}
    return remaindered(np.array([found[q] for q in primes], np.int64), primes)


def roots_beyond(polynomial: list[int], point: int) -> int:
    """How many roots of a polynomial with real roots only are larger than `point`: the sign changes after the shift."""
    c = list(polynomial[::-1])
    for end in range(len(c), 1, -1):
        for at in range(1, end):
            c[at] += point * c[at - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], wanted: int) -> list[tuple[int, int]]:
    """The largest positive roots, falling, repeated ones as often as they occur: (m, s) for a root in (m - 1, m] / 2**s."""
    degree = len(polynomial) - 1
    zeros = next(at for at, x in enumerate(polynomial) if x)
    reduced = polynomial[zeros:]
    wanted = min(wanted, degree - zeros)
    roots: list[tuple[int, int]] = []
    shift, counts, scaled = 0, {}, reduced
    top = int(-reduced[-2]).bit_length() if len(reduced) > 1 else 0
    while len(roots) < wanted:
        low, high = 0, 1 << (top + shift)
        while high - low > 1:
            middle = (low + high) // 2
            if middle not in counts:
                counts[middle] = roots_beyond(scaled, middle)
            low, high = (middle, high) if counts[middle] > len(roots) else (low, middle)
        if high.bit_length() >= ROOT_BITS:
            roots.append((high, shift))
        else:  # not narrow enough: the same on a finer grid
            shift += ROOT_BITS + 1 - high.bit_length()
            counts, scaled = {}, [x << (shift * (len(reduced) - 1 - at)) for at, x in enumerate(reduced)]
    return roots


def null_vectors(m: np.ndarray, roots: list[tuple[int, int]]) -> np.ndarray:
    """A unit vector of the null space of m - root for each root, by inverse iteration, orthogonal to those before."""
    size = len(m)
    found: list[np.ndarray] = []
    with localcontext() as context:
        context.prec = DIGITS
        exact = np.array([[Decimal(int(x)) for x in row] for row in m], object).reshape(size, size)
        largest = max([abs(x) for x in exact.ravel()], default=Decimal(1)) or Decimal(1)
        tiny = largest.scaleb(10 - DIGITS)
        for number, (root, shift) in enumerate(roots):
            work = exact.copy()
            work[np.diag_indices(size)] -= Decimal(root) / Decimal(1 << shift)
            order = np.arange(size)
            for k in range(size):  # the factors take the places below the diagonal
                pivot = k + max(range(size - k), key=lambda at: abs(work[k + at, k]))
                work[[k, pivot]], order[[k, pivot]] = work[[pivot, k]], order[[pivot, k]]
                if abs(work[k, k]) < tiny:
                    work[k, k] = tiny
                work[k + 1 :, k] /= work[k, k]
                work[k + 1 :, k + 1 :] -= np.outer(work[k + 1 :, k], work[k, k + 1 :])
            vector = np.array([Decimal(1 + (7919 * (number + 1) * (at + 1)) % 1009) for at in range(size)], object)
            for _ in range(4):
                vector = vector[order]
                for k in range(size):
                    vector[k + 1 :] -= work[k + 1 :, k] * vector[k]
                for k in range(size - 1, -1, -1):
                    vector[k] = vector[k] / work[k, k]
                    vector[:k] -= work[:k, k] * vector[k]
                for _ in range(2):
                    vector = vector / (vector @ vector).sqrt()
                    for other in found:
                        vector = vector - other * (other @ vector)
                vector = vector / (vector @ vector).sqrt()
            if vector[max(range(size), key=lambda at: abs(vector[at]))] < 0:
                vector = -vector
            found.append(vector)
        return np.array([[float(x) for x in vector] for vector in found]).reshape(len(found), size).T


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, components: int = 8) -> Whitening:
    """The whitening of all vectors: their leading `components` of positive variance."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = integer_rows(vectors, id_col, vector_col, scale)
    dimensions = rows.select(F.max(F.size("y"))).first()[0] or 0
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} dimensions")
    count, sums, products = exact_sums(rows, dimensions)
    scatter = count * products - np.outer(np.array(sums, object), np.array(sums, object)) if dimensions else np.zeros((0, 0), object)
    trace = int(sum(scatter[i, i] for i in range(dimensions)))
    if not trace:
        return Whitening(count, tuple(sums), np.empty((dimensions, 0)), np.empty(0), np.empty(0))
    common = math.gcd(*scatter.ravel().tolist())
    smaller = scatter // common
    roots = largest_roots(characteristic_polynomial(spark, smaller), components)
    with localcontext() as context:
        context.prec = DIGITS
        exact = [Decimal(root) / Decimal(1 << shift) * common for root, shift in roots]
        variances, explained = [float(x / (Decimal(count) * count)) for x in exact], [float(x / trace) for x in exact]
    return Whitening(count, tuple(sums), null_vectors(smaller, roots), np.array(variances), np.array(explained))


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """`id_col`, `deviation` (sum of squares of n * y - s, exact, decimal) and the array `whitened` of every row that takes part.

    A row longer than the vectors of the fit raises ValueError.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = integer_rows(vectors, id_col, vector_col, scale)
    shipped = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        own: Whitening = shipped.value
        scaled = own.vectors / np.sqrt(own.variances)
        largest_sum = max(map(abs, own.sums), default=0)
        for batch in batches:
            if len(batch) and int(np.diff(batch.column(1).offsets.to_numpy()).max()) > len(own.sums):
                raise ValueError("a vector is longer than those of the fit")
            y = matrix(batch.column(1), len(own.sums))
            most = int(np.abs(y).max(initial=0)) * own.count + largest_sum
            kind = np.int64 if most < 1 << 63 else object
            centred = y.astype(kind) * own.count - np.array(own.sums, kind)
            squares = (centred * centred if most * most * max(1, len(own.sums)) < 1 << 63 else centred.astype(object) ** 2).sum(axis=1)
            whitened = centred.astype(np.float64) / max(1, own.count) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(x) for x in squares.tolist()], pa.decimal128(38, 0)), pa.array(list(whitened), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(work, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def identity_error(whitened: DataFrame, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance of whitened rows minus the identity, measured over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, 0, 0
        for batch in batches:
            if len(batch):
                w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                count, sums, products = count + len(w), sums + w.sum(axis=0), products + w.T @ w
        values = [float(count), *sums, *products.ravel()] if count else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], ["cell", "value"])

    total = whitened.select(column).mapInArrow(work, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toArrow()["value"].to_numpy()
    size = math.isqrt(len(total))  # of 1 + size + size**2 values
    if size * (size + 1) + 1 != len(total):
        size -= 1
    if size <= 0:
        return 0.0
    mean = total[1 : 1 + size] / total[0]
    covariance = total[1 + size :].reshape(size, size) / total[0] - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(size)).max())


def component_rows(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """One row for each vector and component: id_col, component, n, deviation, whitened, explained, identity_error."""
    rows = transform(vectors, model, id_col, vector_col, scale)
    error = identity_error(rows)
    spread = rows.select(F.col(id_col), F.col("deviation"), F.posexplode("whitened").alias("_place", "whitened"))
    shares = F.array(*[F.lit(float(x)) for x in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    return spread.select(
        F.col(id_col), (F.col("_place") + 1).cast("int").alias("component"), F.lit(model.count).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.get(shares, F.col("_place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
