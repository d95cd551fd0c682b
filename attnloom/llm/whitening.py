"""Whitening of embeddings from the exact characteristic polynomial of their scatter.

Entries become integers, x = floor(256 * c). Over the distinct vectors Spark sums
the integer scatter M = n * sum(x x') - S S' without rounding (M / n**2 is the
covariance). Its characteristic polynomial is found modulo many primes, a task
per group of primes reducing M to Hessenberg form, and joined by Chinese
remaindering; enough primes are taken for twice the largest coefficient. All
roots are real, so the sign changes of the polynomial shifted by `a` are exactly
the number of roots above `a`: this isolates the largest roots with their
multiplicities, and bisection refines them to PRECISE bits. For each root a task
solves for the null space of M - root by inverse iteration in decimal arithmetic.

The driver holds the d x d scatter, the polynomial and the components, whose
size depends on the dimension only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

STEP, COMPONENTS = 256, 4
#: Roots closer than this share of the larger one count as one multiple root; roots are refined to PRECISE bits.
CLOSE, PRECISE = 128, 192
DIGITS, SWEEPS = 140, 3
_LIMB, _EXACT = 22, 1 << 53
_HALF = 62


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their sums, and the components as rows with eigenvalue, deviation and explained share."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    scales: tuple[float, ...]
    explained: tuple[float, ...]


def integers(vector: str) -> Column:
    """floor(256 * c) of every entry; beyond 64 bits the nearest long."""
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * float(STEP)).cast("long"))


def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds only finite entries."""
    odd = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & ~odd)


# ------------------------------------------------------------ exact sums


def cross_sums(x: np.ndarray) -> np.ndarray:
    """x' x of int64 rows, as Python integers, through exact float products of limbs."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    most = int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    if most < 1 << _LIMB:
        rows = max(1, _EXACT // max(1, most * most))
        for at in range(0, len(x), rows):
            part = x[at : at + rows].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        return total
    low = (1 << _LIMB) - 1
    limbs = [x & low, (x >> _LIMB) & low, x >> 2 * _LIMB]
    rows = _EXACT >> 2 * _LIMB
    for at in range(0, len(x), rows):
        parts = [limb[at : at + rows].astype(np.float64) for limb in limbs]
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return total


def _sums(d: int):
    """Per task the exact sums of rows and of products, in two halves so that the JVM can add them as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d + 1, d + 1), object), 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x = flat.reshape(-1, d)
            for at in range(0, len(x), 1 << 14):
                own = x[at : at + (1 << 14)]
                total[:d, :d] += cross_sums(own)
                total[d, :d] += ((own >> _LIMB).sum(0).astype(object) << _LIMB) + (own & ((1 << _LIMB) - 1)).sum(0).astype(object)
                n += len(own)
        if n:
            total[d, d] = n
            i, j = np.tril_indices(d + 1)
            values = [int(v) for v in total[i, j]]
            high, low = [Decimal(v >> _HALF) for v in values], [Decimal(v & ((1 << _HALF) - 1)) for v in values]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, kind), pa.array(low, kind)], ["i", "j", "high", "low"])

    return run


def scatter(distinct: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and the integer scatter n * sum(x x') - S S' of the rows (x) of length d."""
    parts = distinct.select("x").mapInArrow(_sums(d), "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    of = {(r["i"], r["j"]): (int(r["high"]) << _HALF) + int(r["low"]) for r in rows}
    if not of:
        return 0, [0] * d, []
    n, sums = of[d, d], [of[d, j] for j in range(d)]
    return n, sums, [[n * of[max(i, j), min(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


# ------------------------------------------------------------ characteristic polynomial


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # decides all numbers below 3,215,031,751
        if base % n == 0:
            continue
        y = pow(base, odd, n)
        if y not in (1, n - 1) and all((y := y * y % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2**31, largest first, whose product exceeds twice the bound."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """Similar upper Hessenberg form of `a` modulo the prime p, in place."""
    for k in range(len(a) - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            a[[k + 1, r]] = a[[r, k + 1]]
            a[:, [k + 1, r]] = a[:, [r, k + 1]]
        by = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :, k:] = (a[k + 2 :, k:] - by[:, None] * a[k + 1, k:] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * by % p).sum(1)) % p
    return a


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo p, lowest power first."""
    d = len(a)
    h = hessenberg(a.copy(), p)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        new = (np.roll(polys[k], 1) - h[k, k] * polys[k] % p) % p
        chain, factors = 1, []
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            factors.append(chain * int(h[i, k]) % p)
        if factors:
            terms = polys[k - len(factors) : k][::-1]
            new = (new - (np.array(factors, np.int64)[:, None] * terms % p).sum(0)) % p
        polys[k + 1] = new
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), lowest power first, of a symmetric matrix without negative roots."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # the sizes of the coefficients add up to the product of (1 + root), at most (1 + trace / d) ** d
    moduli = primes_for((2 + trace // d) ** d)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in frame["id"]:
                p = moduli[at]
                reduced = np.array([[v % p for v in row] for row in matrix], np.int64)
                yield pd.DataFrame({"prime": [p], "rest": [polynomial_modulo(reduced, p).tolist()]})

    tasks = min(len(moduli), max(1, spark.sparkContext.defaultParallelism))
    rests = spark.range(0, len(moduli), 1, tasks).mapInPandas(run, "prime long, rest array<long>").collect()
    product = 1
    for p in moduli:
        product *= p
    shares = [(product // r["prime"]) * pow(product // r["prime"], -1, r["prime"]) for r in rests]
    joined = [sum(s * r["rest"][k] for s, r in zip(shares, rests, strict=True)) % product for k in range(d + 1)]
    return [c - product if 2 * c > product else c for c in joined]


# ------------------------------------------------------------ roots


def roots_above(c: list[int], m: int, s: int) -> int:
    """Number of roots above m / 2**s, with multiplicity, of a polynomial that has only real roots."""
    d = len(c) - 1
    q = [v << (s * (d - i)) for i, v in enumerate(c)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            q[j] += m * q[j + 1]
    signs = [v > 0 for v in q if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(c: list[int], m: int, s: int) -> int:
    d, total = len(c) - 1, c[-1]
    for i in range(d - 1, -1, -1):
        total = total * m + (c[i] << (s * (d - i)))
    return total


def largest_roots(c: list[int], wanted: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots with multiplicities, falling, until `wanted` are counted."""
    d = len(c) - 1
    zeros = next(i for i, v in enumerate(c) if v)
    wanted = min(wanted, d - zeros)
    if not wanted:
        return []
    top = abs(c[d - 1])  # the trace bounds every root
    found: list[tuple[Fraction, int]] = []
    # intervals (low, high] / 2**s, highest last, with the number of roots above each end
    open_ = [(0, top, 0, d - zeros, 0)]
    while open_ and sum(k for _, k in found) < wanted:
        low, high, s, above_low, above_high = open_.pop()
        held = above_low - above_high
        if not held:
            continue
        if held == 1:
            found.append((_refined(c, low, high, s, above_high), 1))
            continue
        if (high - low) << CLOSE <= high:
            found.append((Fraction(low + high, 2 << s), held))
            continue
        if high - low < 2:
            low, high, s = low << 8, high << 8, s + 8
        middle = (low + high) // 2
        above = roots_above(c, middle, s)
        open_ += [(low, middle, s, above_low, above), (middle, high, s, above, above_high)]
    return found


def _refined(c: list[int], low: int, high: int, s: int, above: int) -> Fraction:
    """The one root in (low, high] / 2**s by the sign of the polynomial, which tells whether the number of roots above is odd."""
    while (high - low) << PRECISE > high:
        if high - low < 2:
            low, high, s = low << 32, high << 32, s + 32
        middle = (low + high) // 2
        value = _value(c, middle, s)
        if not value:
            return Fraction(middle, 1 << s)
        low, high = (low, middle) if (value < 0) == bool(above % 2) else (middle, high)
    return Fraction(low + high, 2 << s)


# ------------------------------------------------------------ null spaces


def null_space(matrix: list[list[int]], root: Fraction, dimensions: int) -> np.ndarray:
    """Unit vectors, orthogonal to each other, that (matrix - root) all but sends to zero: inverse iteration in decimals."""
    d = len(matrix)
    with localcontext(Context(prec=DIGITS)):
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = [[Decimal(v) for v in row] for row in matrix]
        for i in range(d):
            a[i][i] -= shift
        tiny = shift.scaleb(-DIGITS // 2)
        order = list(range(d))
        for k in range(d):  # a = L U with rows exchanged
            r = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[r] = a[r], a[k]
            order[k], order[r] = order[r], order[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            pivot = a[k]
            for i in range(k + 1, d):
                row = a[i]
                if row[k]:
                    by = row[k] = row[k] / pivot[k]
                    for j in range(k + 1, d):
                        row[j] -= by * pivot[j]
        # starting vectors: fixed, of full rank, in no special direction
        vectors = [[Decimal(pow(3, (i + 1) * (q + 2), 10007) - 5003) + Decimal(i == q) for i in range(d)] for q in range(dimensions)]
        for _ in range(SWEEPS):
            solved = []
            for v in vectors:
                y = [v[r] for r in order]
                for i in range(d):
                    y[i] -= sum((a[i][j] * y[j] for j in range(i)), Decimal(0))
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
                solved.append(y)
            vectors = []
            for y in solved:
                for _ in range(2):
                    size = sum((v * v for v in y), Decimal(0)).sqrt()
                    y = [v / size for v in y]
                    for other in vectors:
                        by = sum((p * q for p, q in zip(y, other, strict=True)), Decimal(0))
                        y = [p - by * q for p, q in zip(y, other, strict=True)]
                size = sum((v * v for v in y), Decimal(0)).sqrt()
                vectors.append([v / size for v in y])
        out = np.array([[float(v) for v in y] for y in vectors])
    heaviest = out[np.arange(dimensions), np.abs(out).argmax(1)]
    return out * np.where(heaviest < 0, -1.0, 1.0)[:, None]


def _null_spaces(spark: SparkSession, matrix: list[list[int]], roots: list[tuple[Fraction, int]]) -> np.ndarray:
    """One task per root."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in frame["id"]:
                vectors = null_space(matrix, *roots[at])
                yield pd.DataFrame({"root": at, "place": range(len(vectors)), "axis": vectors.tolist()})

    rows = spark.range(0, len(roots), 1, len(roots)).mapInPandas(run, "root long, place long, axis array<double>").collect()
    return np.array([r["axis"] for r in sorted(rows, key=lambda r: (r["root"], r["place"]))])


# ------------------------------------------------------------ operator


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct integer vectors, and these (x), stored.

    Of several lengths the one of most distinct vectors is fitted, the longer of
    equally frequent ones; empty vectors count as length 0 and give no
    components. None if no direction has any variance.
    """
    spark = vectors.sparkSession
    distinct = stored(whole(vectors, vector).select(integers(vector).alias("x")).distinct(), "integer-vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    distinct = distinct.filter(F.size("x") == d)
    if not d:
        return None, distinct
    n, sums, matrix = scatter(distinct, d)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return None, distinct
    roots = largest_roots(characteristic_polynomial(spark, matrix), components)
    axes = _null_spaces(spark, matrix, roots)[:components]
    values = [root for root, times in roots for _ in range(times)][:components]
    with localcontext(Context(prec=60)):
        scales = tuple(float((Decimal(v.numerator) / Decimal(v.denominator)).sqrt() / n) for v in values)
    return Whitening(n, tuple(sums), axes, scales, tuple(float(v / trace) for v in values)), distinct


def _projected(model: Whitening, keep: list[str]):
    d = len(model.sums)
    sums, n = np.array(model.sums, object), model.n
    scaled = model.axes / np.array(model.scales)[:, None]
    # above this the products leave 64 bits, and Python integers take over
    safe = max(map(abs, model.sums)) + n * (1 << 20) < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                column = part.column(part.schema.get_field_index("x"))
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
                narrow = safe and (not x.size or int(np.abs(x).max()) < 1 << 20) and x.min(initial=0) > -(1 << 20)
                centred = n * x - sums.astype(np.int64) if narrow else n * x.astype(object) - sums
                far = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
                squares = centred if far * far * d < 1 << 63 else centred.astype(object)
                deviation = [int(v) if v < 1 << 63 else None for v in (squares * squares).sum(1)]
                white = (centred.astype(np.float64) / n) @ scaled.T
                k = len(scaled)
                columns = [part.column(part.schema.get_field_index(c)).take(pa.array(np.repeat(np.arange(len(x)), k))) for c in keep]
                columns += [pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.repeat(np.array(deviation, object), k).tolist(), pa.int64()), pa.array(white.ravel())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "component", "deviation", "whitened"])

    return run


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, from centred products in Spark."""
    k = len(model.axes)
    rows = distinct.withColumn("id", F.monotonically_increasing_id()).mapInArrow(_projected(model, ["id"]), "id long, component int, deviation long, whitened double")
    wide = rows.groupBy("id").agg(*[F.max(F.when(F.col("component") == c + 1, F.col("whitened"))).alias(f"w{c}") for c in range(k)])
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    found = wide.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whitened(vectors: DataFrame, key: str = "vec_id", components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for every usable row and component.

    Rows whose vector is null, holds null or non-finite entries, or has another
    length than the fitted one are dropped. Repeated rows and rows of a null key
    are returned as they come. There are at most as many components as
    directions with variance, so a table of one distinct vector, like an empty
    one, gives no rows. A deviation beyond 64 bits is null. Equal eigenvalues
    have some orthonormal basis. Other columns are ignored.
    """
    model, distinct = fit(vectors, components, vector)
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, deviation long, whitened double"
    rows = whole(vectors, vector).select(F.col(key), integers(vector).alias("x"))
    if model is None:
        rows = rows.limit(0).select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("deviation", "long"), ("whitened", "double"))])
        n, explained, error = 0, F.lit(None).cast("double"), 0.0
    else:
        n, error = model.n, identity_error(distinct, model)
        explained = F.element_at(F.array(*[F.lit(e) for e in model.explained]), F.col("component"))
        rows = rows.filter(F.size("x") == len(model.sums)).mapInArrow(_projected(model, [key]), schema)
    return rows.select(key, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`whitened` of all rows of `embeddings`."""
    return whitened(read_table(spark, sf_dir, "embeddings"))
