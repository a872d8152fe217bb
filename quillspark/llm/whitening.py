"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors are put on a grid, x = floor(64 c) + 1000000. The fit list is each distinct x once. Its
scatter C = n * sum(x x') - S S' = n^2 * V is an integer matrix and is summed exactly: each task
multiplies blocks of 20-bit limbs in double precision, where no sum reaches 2**53, and adds them up
as integers (of x less the grid's offset, which cancels in C); Spark adds the tasks' entries as
decimals. Then, all of it of a size that follows the width of the vectors and not their number:

* the characteristic polynomial of C modulo primes below 2**31, by Hessenberg reduction, a group of
  primes per task, is put together by Chinese remaindering: as many primes as the bound on the
  coefficients of a positive semidefinite matrix takes, and one more that must agree;
* all roots are real, so the sign changes of the polynomial's Taylor shift count exactly the roots
  beyond a point; bisection with such counts isolates the largest ones, also repeated ones;
* a task per isolated root bisects it to as many bits as needed and finds its eigenvectors by inverse
  iteration in fixed-point integers, until two iterations span the same space to 2**-64.

Vectors of more entries cost more: about width**3 steps per prime and (bits of C) * width / 31
primes. Roots nearer to one another than 2**-256 of the trace count as one repeated root, with any
orthonormal basis of their common space.

Defined results: null ids are kept; a vector that is null, empty or holds a null, a NaN or an
infinity is left out; so is one whose length is not the fit list's most frequent (the greater at a
tie); an entry beyond 2**56 counts as 2**56; a repeated row gives its rows again; components of no
variance do not exist, so that equal vectors, one vector or none give no rows; a deviation beyond
64 bits is null.
"""

from __future__ import annotations

import math
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch

GRID, OFFSET, MOST = 64, 1_000_000, float(1 << 56)
_LIMB, _ROWS = 20, 4096  # 4096 * 2**40 < 2**53
_CUT = 60
_SAME = 256


def on_grid(df: DataFrame, vector_col: str, x_col: str = "x") -> DataFrame:
    """`df` with the grid vector of each row that has one; other rows go. A column named `x_col` is replaced."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    point = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * GRID, F.lit(MOST)), F.lit(-MOST))) + OFFSET)
    return df.where(v.isNotNull() & (F.size(v) > 0) & sound).withColumn(x_col, point)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


# -- the exact scatter ------------------------------------------------------------------------


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y of 64-bit integers (at most `_ROWS` rows), exact, as Python integers."""
    limbs, rest = [], y
    while True:
        if np.abs(rest).max(initial=0) < 1 << _LIMB:
            limbs.append(rest.astype(float))
            break
        limbs.append((rest & ((1 << _LIMB) - 1)).astype(float))
        rest = rest >> _LIMB
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << _LIMB * (i + j)
    return total


def scatter(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """The number of fit vectors, their sums, and n**2 times their covariance, all exact integers."""

    def run(batches):
        n, sums, gram = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = _matrix(batch.column("x"), width) - OFFSET
            n += len(y)
            for at in range(0, len(y), _ROWS):
                block = y[at : at + _ROWS]
                sums += (block >> 32).sum(0).astype(object) * (1 << 32) + (block & 0xFFFFFFFF).sum(0).astype(object)
                gram += exact_gram(block)
        if n:
            i, j = np.triu_indices(width)
            values = [n, *sums, *gram[i, j]]
            parts = [pa.array([Decimal(int(v) >> _CUT) for v in values], pa.decimal128(38)), pa.array([Decimal(int(v) & ((1 << _CUT) - 1)) for v in values], pa.decimal128(38))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *parts], names=["k", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "k int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # width**2 / 2 rows
    value = {r.k: (int(r.high) << _CUT) + int(r.low) for r in rows}
    n, sums = value[0], np.array([value[1 + k] for k in range(width)], object)
    gram = np.zeros((width, width), object)
    i, j = np.triu_indices(width)
    gram[i, j] = gram[j, i] = [value[1 + width + k] for k in range(len(i))]
    return n, [s + n * OFFSET for s in sums], n * gram - np.outer(sums, sums)


# -- its characteristic polynomial ------------------------------------------------------------


def _prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3.2e9."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes from 2**31 down whose product exceeds `bound`, and one more."""
    found, product, p = [], 1, 1 << 31
    while product <= bound:
        p -= 1
        if _prime(p):
            found.append(p)
            product *= p
    while not _prime(p := p - 1):
        pass
    return [*found, p]


def polynomial_mod(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients, lowest first, of det(t - matrix) modulo each prime below 2**31: a row per prime."""
    d, p = len(matrix), np.array(primes, np.int64)
    h = np.stack([(matrix % q).astype(np.int64) for q in primes])
    each, p2, p3 = np.arange(len(p)), p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        pivot = m + (h[:, m:, m - 1] != 0).argmax(1)
        rows = h[each, pivot].copy()
        h[each, pivot], h[:, m] = h[:, m].copy(), rows
        columns = h[each, :, pivot].copy()
        h[each, :, pivot], h[:, :, m] = h[:, :, m].copy(), columns
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, m, m - 1], primes)], np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p2
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m : m + 1] % p3) % p3
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p3).sum(2)) % p2
    poly = np.zeros((len(p), d + 1, d + 1), np.int64)  # of the leading blocks
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(p), d + 1), np.int64)
        new[:, 1:] = poly[:, k - 1, :-1]
        new -= h[:, k - 1, k - 1, None] * poly[:, k - 1] % p2
        chain = np.ones(len(p), np.int64)
        for i in range(1, k):
            chain = chain * h[:, k - i, k - i - 1] % p
            new -= (h[:, k - i - 1, k - 1] * chain % p)[:, None] * poly[:, k - i - 1] % p2
        poly[:, k] = new % p2
    return poly[:, d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray, group: int = 8) -> list[int]:
    """Coefficients, lowest first, of det(t - matrix) for a positive semidefinite integer matrix."""
    d, trace = len(matrix), int(np.trace(matrix))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))  # elementary symmetric functions, at equal roots
    primes = primes_beyond(2 * bound)
    groups = [primes[k : k + group] for k in range(0, len(primes), group)]

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                found = polynomial_mod(matrix, groups[k])
                yield pa.RecordBatch.from_arrays([pa.array(groups[k]), pa.array(list(found), pa.list_(pa.int64()))], names=["prime", "coefficients"])

    rows = spark.range(0, len(groups), 1, len(groups)).mapInArrow(run, "prime long, coefficients array<long>").collect()
    found = {r.prime: r.coefficients for r in rows}
    *used, check = primes
    product = math.prod(used)
    parts = [(found[q], (product // q) * pow(product // q, -1, q)) for q in used]
    out = [sum(c[k] * part for c, part in parts) % product for k in range(d + 1)]
    out = [c - product if 2 * c > product else c for c in out]
    if any((c - r) % check for c, r in zip(out, found[check])):
        raise ArithmeticError("the characteristic polynomial disagrees modulo a further prime")
    return out


# -- its roots --------------------------------------------------------------------------------


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """How many roots of a real-rooted polynomial exceed num / 2**bits >= 0, repeated ones counted as often."""
    d = len(poly) - 1
    b = [c * num**k << bits * (d - k) for k, c in enumerate(poly)] if num else list(poly)
    for i in range(d if num else 0):
        for j in range(d - 1, i - 1, -1):
            b[j] += b[j + 1]
    signs = [c > 0 for c in b if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _point(num: int, bits: int) -> tuple[int, int]:
    """num / 2**bits with bits >= 0."""
    return (num << -bits, 0) if bits < 0 else (num, bits)


def isolate(poly: list[int], top: int) -> list[tuple[int, int, int, int]]:
    """The largest `top` positive roots, descending, as (low, bits, above, count): `count` roots lie in
    (low, low + 1] / 2**bits and `above` roots beyond. Several only where they lie closer than 2**-256 of all roots' sum."""
    total = max(-poly[-2], 1)
    bits = -total.bit_length()  # the interval (0, 2**-bits]
    todo, found = [(0, bits, 0, roots_above(poly, 0, 0))], []
    while todo:
        low, b, above, n = todo.pop()
        if not n or above >= top:
            continue
        if low and (n == 1 or b >= bits + _SAME):
            found.append((low, b, above, n))
            continue
        upper = roots_above(poly, *_point(2 * low + 1, b + 1))
        todo += [(2 * low, b + 1, upper, n - (upper - above)), (2 * low + 1, b + 1, above, upper - above)]
    return found


def _value(poly: list[int], num: int, bits: int) -> int:
    """2**(bits * d) times the polynomial at num / 2**bits."""
    total, scale = poly[-1], 0
    for c in reversed(poly[:-1]):
        scale += bits
        total = total * num + (c << scale)
    return total


def refine(poly: list[int], low: int, bits: int, above: int, count: int, more: int) -> tuple[int, int]:
    """The interval of `isolate`, halved `more` times: (low, bits)."""
    falls = above % 2 == 0  # the sign just beyond a simple root; beyond all roots the polynomial is positive
    for _ in range(more):
        low, bits = 2 * low, bits + 1
        if count == 1:
            v = _value(poly, *_point(low + 1, bits))
            beyond = v != 0 and (v > 0) != falls
        else:
            beyond = roots_above(poly, *_point(low + 1, bits)) - above >= count
        low += beyond
    return low, bits


# -- eigenvectors -----------------------------------------------------------------------------


def _solved(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Columns x with a x = b, up to one common factor each, in integers; `a` has `bits` binary places."""
    d, m = len(a), np.concatenate([a, b], 1)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(m[k:, k])))
        if pivot != k:
            m[[k, pivot]] = m[[pivot, k]]
        if m[k, k] == 0:
            m[k, k] = 1
        share = (m[k + 1 :, k] << bits) // m[k, k]
        m[k + 1 :, k:] -= (share[:, None] * m[k, k:]) >> bits
    x = np.zeros(b.shape, object)
    for k in range(d - 1, -1, -1):
        x[k] = ((m[k, d:] << bits) - (m[k, k + 1 : d, None] * x[k + 1 :]).sum(0)) // m[k, k]
    return x


def _orthonormal(x: np.ndarray, bits: int) -> np.ndarray:
    """The columns made orthonormal in fixed-point integers of `bits` places; each one's largest entry is positive."""
    out = []
    for v in x.T:
        for _ in range(2):  # the second time mends what the first lost
            v = (v << bits) // max(1, math.isqrt(int((v * v).sum())))
            for w in out:
                v = v - (int((v * w).sum()) * w >> 2 * bits)
        v = (v << bits) // max(1, math.isqrt(int((v * v).sum())))
        out.append(v if v[int(np.argmax(np.abs(v)))] > 0 else -v)
    return np.array(out, object).T


def eigenvectors(matrix: np.ndarray, poly: list[int], root: tuple[int, int, int, int]) -> tuple[Fraction, np.ndarray]:
    """An isolated root, to 2**-100 of itself at least, and orthonormal vectors of its null space (rows, double precision)."""
    low, bits, above, count = root
    size, r = int(np.abs(matrix).max()).bit_length(), random.Random(len(matrix))
    more = 128
    while True:
        near, scale = refine(poly, low, bits, above, count, more)
        places = scale + size + 128
        a = matrix << places
        a[np.diag_indices(len(a))] -= (2 * near + 1) << (places - scale - 1)  # the interval's middle
        unit, x = places + 64, np.array([[r.getrandbits(62) - (1 << 61) for _ in range(count)] for _ in matrix], object)
        before = None
        for _ in range(2):
            before, x = x, _orthonormal(_solved(a, x << 64, unit), 192)
        inside = (before @ (before.T @ x)) >> 2 * 192
        if int(np.abs(x - inside).max()) >> (192 - 64) == 0:
            return Fraction(2 * near + 1) / Fraction(2) ** (scale + 1), (x.T >> 192 - 80).astype(float) / 2.0**80
        more *= 2
        if more > 1 << 14:
            raise ArithmeticError("inverse iteration did not settle")


def components(spark: SparkSession, n: int, matrix: np.ndarray, top: int) -> list[tuple[float, float, list[float]]]:
    """(eigenvalue of the covariance, its share of the trace, unit eigenvector) of the largest `top` positive eigenvalues."""
    if not any(matrix.diagonal()):
        return []
    poly = characteristic_polynomial(spark, matrix)
    roots = isolate(poly, top)
    trace = int(np.trace(matrix))

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                value, vectors = eigenvectors(matrix, poly, roots[k])
                rows = [(roots[k][2] + i, float(value / n**2), float(value / trace), v.tolist()) for i, v in enumerate(vectors)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k", "e", "share", "vector"])

    rows = spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "k long, e double, share double, vector array<double>").collect()
    return [(r.e, r.share, r.vector) for r in sorted(rows, key=lambda r: r.k)][:top]


# -- the operator -----------------------------------------------------------------------------


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, pa.Array]:
    """n x - S as doubles, and the exact sums of its squares."""
    top = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    if top < 1 << 62:
        moved = n * x - np.array(sums, np.int64)
        if int(np.abs(moved).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return moved.astype(float), pa.array((moved * moved).sum(1))
        moved = moved.astype(object)
    else:
        moved = n * x.astype(object) - np.array(sums, object)
    exact = [int(v) for v in (moved * moved).sum(1)]
    return moved.astype(float), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 16) -> DataFrame:
    """A row for each usable row of `df` and each of the `top` components at most: the id, component, n, deviation,
    whitened, explained and identity_error."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    points = on_grid(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v").select("id", "x")
    fit = scratch.keep(points.select("x").distinct())
    widths = fit.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    found, n, sums, wrong = [], 0, [], 0.0
    if widths:
        width = widths[0].width
        points, fit = points.where(F.size("x") == width), fit.where(F.size("x") == width)
        n, sums, matrix = scatter(fit, width)
        found = components(spark, n, matrix, top)
    turn = np.zeros((0, 0))
    if found:
        turn = np.array([v for _, _, v in found]).T / np.sqrt([e for e, _, _ in found])
        wrong = _identity_error(fit, n, sums, turn)
    else:
        points = points.where(F.lit(False))
    shares = np.array([s for _, s, _ in found])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                moved, deviation = _deviations(_matrix(batch.column("x"), len(turn)), n, sums)
                white, k = (moved / n) @ turn, len(shares)
                row = pa.array(np.repeat(np.arange(len(white)), k))
                total = len(row)
                columns = [batch.column("id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(white))), pa.array(np.full(total, n)), deviation.take(row)]
                columns += [pa.array(white.ravel()), pa.array(np.tile(shares, len(white))), pa.array(np.full(total, wrong))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = points.schema["id"].dataType.simpleString()
    out = points.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)


def _identity_error(fit: DataFrame, n: int, sums: list[int], turn: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = turn.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                white = (_deviations(_matrix(batch.column("x"), len(turn)), n, sums)[0] / n) @ turn
                total += np.concatenate([white.T @ white, white.sum(0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(k * (k + 1)), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    rows = fit.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) rows
    total = np.zeros(k * (k + 1))
    for r in rows:
        total[r.k] = r.v
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
