"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries become whole numbers, x = floor(scale * c) + offset. Every distinct x vector once is the fit list
(a written table). With n vectors, sums S and cross products, A = n * sum(x x') - S S' is an integer
matrix, n^2 times the covariance, and is summed exactly: tasks add products of 20-bit digits, which double
precision holds without rounding, and Spark adds their 40-bit digits. What follows depends on the number of
dimensions only, not on the rows:

1. the characteristic polynomial of A (its common factor taken out): modulo enough 31-bit primes each
   Spark task brings A to Hessenberg form and reads the polynomial off it; Chinese remaindering gives the
   integer coefficients, as their size is bounded by the trace;
2. the eigenvalues: all roots are real and none is negative, so the sign changes of the shifted polynomial
   (Descartes) count the roots above a point exactly, with multiplicities. Bisection isolates every
   distinct root (their number is known from the gcd with the derivative) and narrows the
   largest ones far below the gaps between them;
3. the components: tasks solve (A - root) v = start by LU in fixed-point whole numbers, twice per
   root, and orthonormalise as many vectors as the root has multiplicity.

Rows are then projected in tasks. The identity error comes from two more passes over the fit list, sums first.

Defined results: rows whose vector is null, holds null or non-finite entries, or has another length than
most (ties: the longer) are left out. Products beyond 2**62 are held there. Only positive eigenvalues have
components, so there are at most rank many; without any (no rows, one distinct vector) the result is
empty. Within a repeated eigenvalue the components are some orthonormal basis. A deviation beyond a long is null.
Repeated rows and null ids are returned each. Extra columns are ignored. Signs: the largest entry of a component is positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = 1 << 62
# Digits of the task-wise products, vectors multiplied at once, and digits of the sums in Spark.
DIGIT, VECTORS_AT_ONCE = 20, 4096
SUM_DIGIT, SUM_DIGITS = 40, 6
# Bits to which roots are known below the trace at first, further bits when gaps ask for it, and bits kept beyond a gap.
ROOT_BITS, MORE_BITS, BEYOND_GAP = 192, 128, 96


def quantised(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """Whole numbers of a vector; null where an entry is null or not finite."""
    values = vector.cast("array<double>")
    finite = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    held = lambda c: F.greatest(F.least(c * float(scale), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return F.when(finite, F.transform(values, lambda c: F.floor(held(c)).cast("long") + offset))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def cross_products(y: np.ndarray) -> np.ndarray:
    """sum(y y') over the rows as Python integers: exact for any 64-bit entries."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for start in range(0, len(y), VECTORS_AT_ONCE):
        rest, digits = y[start : start + VECTORS_AT_ONCE], []
        while len(rest) and np.abs(rest.astype(np.float64)).max() >= 1 << DIGIT:
            digits.append((rest & ((1 << DIGIT) - 1)).astype(np.float64))
            rest = rest >> DIGIT
        digits.append(rest.astype(np.float64))
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) << (DIGIT * (i + j))
    return total


def digits_of(value: int) -> list[int]:
    """Digits of a whole number, the last one signed."""
    out = []
    for _ in range(SUM_DIGITS - 1):
        out.append(value & ((1 << SUM_DIGIT) - 1))
        value >>= SUM_DIGIT
    return [*out, value]


@dataclass(frozen=True)
class Scatter:
    """Exact sums of the fit list: its size, sums per dimension, and n^2 times the covariance."""

    n: int
    sums: list[int]
    matrix: np.ndarray


def scatter(fit: DataFrame, dimensions: int) -> Scatter:
    """Sums over `fit` (x); only about half of dimensions squared sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dimensions, object), np.zeros((dimensions, dimensions), object)
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column(0)) - OFFSET
                n += len(y)
                products += cross_products(y)
                sums += cross_products(np.hstack([y, np.ones((len(y), 1), np.int64)]))[-1, :-1] if np.abs(y).max() > 1 << 40 else y.sum(axis=0).astype(object)
        if n:
            upper = [(i, j, products[i, j]) for i in range(dimensions) for j in range(i, dimensions)]
            rows = [(-1, -1, n), *((-1, i, sums[i]) for i in range(dimensions)), *upper]
            columns = [[r[0] for r in rows], [r[1] for r in rows], *zip(*(digits_of(int(r[2])) for r in rows))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", *(f"d{k}" for k in range(SUM_DIGITS))])

    digits = [f"d{k}" for k in range(SUM_DIGITS)]
    parts = fit.mapInArrow(run, "i long, j long, " + ", ".join(f"{d} long" for d in digits))
    n, sums, products = 0, [0] * dimensions, np.zeros((dimensions, dimensions), object)
    for row in parts.groupBy("i", "j").agg(*(F.sum(d).alias(d) for d in digits)).collect():
        value = sum(row[d] << (SUM_DIGIT * k) for k, d in enumerate(digits))
        if row["j"] < 0:
            n = value
        elif row["i"] < 0:
            sums[row["j"]] = value
        else:
            products[row["i"], row["j"]] = products[row["j"], row["i"]] = value
    # Covariances do not feel the offset, which is left out of the products.
    centred = n * products - np.multiply.outer(np.array(sums, object), np.array(sums, object))
    return Scatter(n, [s + n * OFFSET for s in sums], centred)


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every number below 3.3e9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_below(top: int, bits: int) -> list[int]:
    """The largest primes below `top` whose product has more than `bits` bits."""
    found, product, n = [], 1, top
    while product.bit_length() <= bits:
        n -= 1
        if n % 2 and is_prime(n):
            found.append(n)
            product *= n
    return found


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of the characteristic polynomial of `a` modulo a prime below 2**31."""
    h, d = (a % p).astype(np.int64), len(a)
    for k in range(1, d - 1):
        found = np.flatnonzero(h[k:, k - 1])
        if not len(found):
            continue
        pivot = k + found[0]
        h[[k, pivot]] = h[[pivot, k]]
        h[:, [k, pivot]] = h[:, [pivot, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(axis=1)) % p
    polynomials = np.zeros((d + 1, d + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(d):
        # Products of the subdiagonal upwards from row k, next to the entries above the diagonal.
        weights, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            weights[i] = product * int(h[i, k]) % p
        row = np.roll(polynomials[k], 1) - h[k, k] * polynomials[k] % p
        polynomials[k + 1] = (row - (weights[:, None] * polynomials[:k] % p).sum(axis=0)) % p
    return polynomials[d]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients, constant first, of det(x - a) for a symmetric integer matrix without negative eigenvalues."""
    d, trace = len(a), int(np.trace(a))
    # Coefficient k is an elementary symmetric function of the roots: at most C(d, k) * (trace / d)**k.
    bits = 2 + d + d * max(1, -(-trace // d)).bit_length()
    primes = primes_below(1 << 31, bits)
    shared = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_modulo(shared.value, p).tolist()], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, c array<bigint>").collect()
    product = math.prod(primes)
    total = [0] * (d + 1)
    for row in rows:
        others = product // row["p"]
        weight = others * pow(others, -1, row["p"])
        total = [t + weight * c for t, c in zip(total, row["c"])]
    halved = product // 2
    return [(t + halved) % product - halved for t in total]


def changes_above(polynomial: list[int], point: Fraction) -> int:
    """Roots above a point of a polynomial with only real roots, counted with multiplicity."""
    d, m, q = len(polynomial) - 1, point.numerator, point.denominator
    # q**d * f((x + m) / q): whole numbers; then Horner's shift.
    shifted = [c * q ** (d - k) for k, c in enumerate(polynomial)]
    for start in range(d):
        for k in range(d - 1, start - 1, -1):
            shifted[k] += m * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(polynomial: list[int], point: Fraction) -> int:
    value, power = 0, 1
    for c in reversed(polynomial):
        value = value * point.numerator + c * power
        power *= point.denominator
    return (value > 0) - (value < 0)


def gcd_degree(f: list[int], p: int) -> int:
    """Degree of gcd(f, f') modulo a prime."""
    a = np.array([c % p for c in reversed(f)], np.int64)
    b = np.array([c * k % p for k, c in reversed(list(enumerate(f)))][:-1], np.int64)
    a, b = np.trim_zeros(a, "f"), np.trim_zeros(b, "f")
    while len(b):
        inverse = pow(int(b[0]), -1, p)
        while len(a) >= len(b):
            a[: len(b)] = (a[: len(b)] - int(a[0]) * inverse % p * b) % p
            a = np.trim_zeros(a, "f")
        a, b = b, a
    return len(a) - 1


@dataclass(frozen=True)
class Root:
    """An eigenvalue in (low, high], how often it occurs, and a bound of the distance to the next one."""

    low: Fraction
    high: Fraction
    times: int
    gap: Fraction

    @property
    def middle(self) -> Fraction:
        return (self.low + self.high) / 2


def narrowed(f: list[int], low: Fraction, high: Fraction, times: int, width: Fraction) -> tuple[Fraction, Fraction]:
    """The isolating interval halved down to a width: by sign for a single root, else by counting."""
    above = sign_at(f, high) if times == 1 else 0
    if times == 1 and not above:
        return high - min(width, high - low), high
    beyond = changes_above(f, high) if times > 1 else 0
    while high - low > width:
        middle = (low + high) / 2
        if times == 1:
            found = sign_at(f, middle)
            if not found:
                return middle - min(width, middle - low), middle
            inside = found != above
        else:
            inside = changes_above(f, middle) > beyond
        low, high = (middle, high) if inside else (low, middle)
    return low, high


def largest_roots(f: list[int], most: int) -> list[Root]:
    """The positive roots of a polynomial whose roots are all real and not negative, falling, until `most` with multiplicity."""
    while f[0] == 0:
        f = f[1:]
    d = len(f) - 1
    if d == 0:
        return []
    distinct = d - min(gcd_degree(f, p) for p in primes_below((1 << 31) - (1 << 20), 31 * 4))
    top = Fraction(1 << (-f[-2]).bit_length())
    # The widest interval is always cut next, until each holds one distinct root.
    parts = {(Fraction(0), top): d}
    counts = {Fraction(0): d, top: 0}
    while len(parts) < distinct:
        low, high = max((p for p, n in parts.items() if n > 1), key=lambda p: p[1] - p[0])
        n, middle = parts.pop((low, high)), (low + high) / 2
        counts[middle] = changes_above(f, middle)
        for a, b in ((low, middle), (middle, high)):
            if counts[a] > counts[b]:
                parts[(a, b)] = counts[a] - counts[b]
    found, wanted = sorted(parts, reverse=True), 0
    times = [parts[p] for p in found]
    while wanted < len(found) and sum(times[:wanted]) < most:
        wanted += 1
    near = min(wanted + 1, len(found))
    bits = ROOT_BITS
    while True:
        width = top / (1 << bits)
        found[:near] = [narrowed(f, *found[i], times[i], width) for i in range(near)]
        # Zero, whose roots were taken out, counts as a neighbour.
        gaps = [found[i][0] for i in range(wanted)]
        for i in range(near - 1):
            between = found[i][0] - found[i + 1][1]
            for k in (i, i + 1):
                if k < wanted:
                    gaps[k] = min(gaps[k], between)
        if all(g > 0 and found[i][1] - found[i][0] <= g / (1 << BEYOND_GAP) for i, g in enumerate(gaps)):
            return [Root(*found[i], times[i], gaps[i]) for i in range(wanted)]
        bits += MORE_BITS


def null_vectors(a: np.ndarray, root: Root) -> list[list[float]]:
    """Orthonormal vectors that span the eigenspace of a root, by inverse iteration in fixed point."""
    d = len(a)
    width = root.high - root.low
    bits = 64 + 2 * max(64, int(root.high / width).bit_length(), int(1 / width).bit_length())
    one = 1 << bits
    centre = root.middle.numerator * one // root.middle.denominator
    m = a * one
    m[np.arange(d), np.arange(d)] -= centre
    # LU with row exchanges; a pivot that vanishes is replaced by the last bit.
    order, factors = list(range(d)), []
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        m[[k, pivot]] = m[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        for old in factors:
            old[k], old[pivot] = old[pivot], old[k]
        m[k, k] = m[k, k] or 1
        factor = [0] * d
        for i in range(k + 1, d):
            factor[i] = m[i, k] * one // m[k, k]
        if k + 1 < d:
            m[k + 1 :, k:] -= np.multiply.outer(np.array(factor[k + 1 :], object), m[k, k:]) >> bits
        factors.append(factor)

    def solve(b: list[int]) -> list[int]:
        b = [b[i] for i in order]
        for k in range(d):
            for i in range(k + 1, d):
                b[i] -= factors[k][i] * b[k] >> bits
        x = [0] * d
        for k in range(d - 1, -1, -1):
            x[k] = (b[k] - (sum(m[k, j] * x[j] for j in range(k + 1, d)) >> bits)) * one // m[k, k]
        return x

    def unit(v: list[int]) -> list[int]:
        length = math.isqrt(sum(c * c for c in v)) or 1
        return [c * one // length for c in v]

    rng, vectors = np.random.default_rng(7), []
    starts = [[int(c) << (bits - 32) for c in rng.integers(-(1 << 31), 1 << 31, d)] for _ in range(root.times)]
    for _ in range(3):
        vectors = []
        for v in starts:
            v = unit(solve(v))
            for _ in range(2):
                for w in vectors:
                    along = sum(x * y for x, y in zip(v, w)) >> bits
                    v = [x - (along * y >> bits) for x, y in zip(v, w)]
                v = unit(v)
            vectors.append(v)
        starts = vectors
    out = []
    for v in vectors:
        sign = 1 if max(v, key=abs) > 0 else -1
        out.append([sign * c / one for c in v])
    return out


@dataclass(frozen=True)
class Whitening:
    """What rows need: n, sums, and per component the projection (over the root of its eigenvalue) and its share of the trace."""

    n: int
    sums: list[int]
    projections: np.ndarray
    explained: list[float]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64 bits if they suffice, else Python integers."""
        n, shift = self.n, np.array([s - self.n * OFFSET for s in self.sums], object)
        y = x - OFFSET
        room = max((abs(int(s)) for s in shift), default=0) + n * max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        return y * np.int64(n) - shift.astype(np.int64) if room < LARGEST else y.astype(object) * n - shift

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ self.projections.T


def square_sums(t: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; null beyond a long."""
    if t.dtype != object and len(t) and int(np.abs(t).max()) ** 2 * t.shape[1] < LARGEST:
        return np.einsum("ij,ij->i", t, t).tolist()
    return [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in t)]


def components(spark: SparkSession, sums: Scatter, most: int = COMPONENTS) -> Whitening:
    """The largest eigenvalues and their components; roots are dealt over tasks."""
    common = math.gcd(*(int(v) for v in sums.matrix.ravel())) or 1
    a = sums.matrix // common
    roots = largest_roots(characteristic_polynomial(spark, a), most) if np.any(a) else []
    shared = spark.sparkContext.broadcast((a, roots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                vectors = null_vectors(*((shared.value[0].copy(), shared.value[1][k])))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(vectors)), pa.array(vectors, pa.list_(pa.float64()))], names=["k", "v"])

    rows = []
    if roots:
        numbers = spark.range(len(roots)).repartition(len(roots)).select(F.col("id").alias("k"))
        rows = sorted(numbers.mapInArrow(run, "k long, v array<double>").collect(), key=lambda r: r["k"])[:most]
    trace = int(np.trace(a))
    values = [roots[r["k"]].middle * common / sums.n**2 for r in rows]
    vectors = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), len(sums.sums))
    projections = vectors / np.sqrt(np.array([float(v) for v in values]))[:, None]
    return Whitening(sums.n, sums.sums, projections, [float(roots[r["k"]].middle / trace) for r in rows])


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity; means first, then centred products."""
    k, shared = len(whitening.projections), fit.sparkSession.sparkContext.broadcast(whitening)

    def sums(means: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k if means is not None else 1))
            for batch in batches:
                if batch.num_rows:
                    z = shared.value.whitened(shared.value.deviations(matrix(batch.column(0))))
                    total += z.sum(axis=0)[:, None] if means is None else (z - means).T @ (z - means)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

        rows = fit.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]) / whitening.n

    means = sums(None)
    return float(np.abs(sums(means).reshape(k, k) - np.eye(k)).max())


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error per row of `rows` (vec_id, embedding) and component.

    Fits while it is called; the returned frame reads `rows` once more.
    """
    spark = rows.sparkSession
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    used = rows.select("vec_id", quantised(F.col("embedding")).alias("x")).filter("x IS NOT NULL")
    lengths = used.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not lengths or not lengths["d"]:
        return spark.createDataFrame([], schema)
    used = used.filter(F.size("x") == lengths["d"])
    fit = stored(used.select("x").distinct(), "whitening-fit")
    whitening = components(spark, scatter(fit, lengths["d"]), most)
    if not len(whitening.projections):
        return spark.createDataFrame([], schema)
    shared, error, k = spark.sparkContext.broadcast(whitening), identity_error(fit, whitening), len(whitening.projections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            t = model.deviations(matrix(batch.column(1)))
            numbers = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(numbers)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                pa.array(square_sums(t), pa.int64()).take(pa.array(numbers)), pa.array(model.whitened(t).ravel()),
                pa.array(np.tile(np.array(model.explained), m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return used.mapInArrow(run, schema)
