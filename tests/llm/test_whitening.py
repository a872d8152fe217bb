"""Whitening against exact and plain versions: the polynomial, its roots, repeated and missing eigenvalues, hard rows."""

import random

import numpy as np
import pytest

from quillspark.llm import whitening as w

R = random.Random(3)


def leverrier(m):
    """det(t - m) by exact traces, lowest coefficient first."""
    n = len(m)
    out, a = [0] * n + [1], np.zeros((n, n), object)
    for k in range(1, n + 1):
        a = m @ a + out[n - k + 1] * np.eye(n, dtype=int).astype(object)
        out[n - k] = -sum((m @ a).diagonal()) // k
    return out


def gram(d, rank, top=9):
    b = np.array([[R.randrange(-top, top + 1) for _ in range(rank)] for _ in range(d)], object)
    return b @ b.T


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (3, 1), (6, 6), (9, 4), (12, 12)])
def test_polynomial(spark, d, rank):
    m = gram(d, rank)
    assert w.characteristic_polynomial(spark, m) == leverrier(m)
    big = m * 3**90
    assert w.characteristic_polynomial(spark, big) == leverrier(big)
    sparse = np.diag([R.randrange(3) for _ in range(d)]).astype(object)
    assert w.characteristic_polynomial(spark, sparse) == leverrier(sparse)


def test_primes():
    found = w.primes_beyond(1 << 100)
    assert len(set(found)) == 5 and all(p < 1 << 31 and all(p % q for q in range(2, 1 << 16)) for p in found)


def test_gram_of_any_size():
    for top in (3, 1 << 20, 1 << 40, 1 << 60):
        y = np.array([[R.randrange(-top, top) for _ in range(4)] for _ in range(30)])
        assert (w.exact_gram(y) == y.astype(object).T @ y.astype(object)).all()


def product(roots):
    poly = [1]
    for r in roots:
        poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    return poly


def test_roots():
    for roots in ([5], [7, 7, 7, 2], [10**40, 10**40 - 1, 3, 3, 0, 0], [1 << 300, 1], [8, 4, 4, 2, 1]):
        poly = product(roots)
        assert w.roots_above(poly, 0, 0) == sum(r > 0 for r in roots)
        for at in {*roots, *(r + 1 for r in roots)}:
            assert w.roots_above(poly, at, 0) == sum(r > at for r in roots)
        found = w.isolate(poly, 3)
        told = [(above, n) for _, _, above, n in found]
        distinct = sorted({r for r in roots if r}, reverse=True)
        want = [(sum(x > r for x in roots), roots.count(r)) for r in distinct]
        assert told == [x for x in want if x[0] < 3]
        for r, root in zip(distinct, found):
            low, bits = w.refine(poly, *root, 100)
            scaled = r << bits if bits >= 0 else r / (1 << -bits)
            assert low < scaled <= low + 1


def plain(x):
    d = np.unique(x, axis=0)
    v = (d - d.mean(0)).T @ (d - d.mean(0)) / len(d)
    e, u = np.linalg.eigh(v)
    return d, e[::-1], u[:, ::-1], v


def held(rows, vectors, top):
    """Rows of `whiten` for {id: float vector} against numpy; repeated eigenvalues by their properties alone."""
    x = {k: np.floor(64 * np.array(v, float)) + 1_000_000 for k, v in vectors.items()}
    d, e, u, v = plain(np.array(list(x.values())))
    n, k = len(d), min(top, int((e > 1e-9 * max(e.max(), 1)).sum()))
    assert len(rows) == k * len(x)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
    exact = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(xi, d.sum(0))) for i, xi in x.items()}
    ids = sorted(x)
    got = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i in ids]).reshape(len(ids), k)
    assert all(by[i][1].deviation == exact[i] for i in ids if k)
    centred = np.array([x[i] for i in ids]) - d.mean(0)
    for c in range(k):
        if all(abs(e[c] - e[o]) > 1e-6 * e[0] for o in range(len(e)) if o != c):
            want = centred @ u[:, c] / np.sqrt(e[c])
            assert min(np.abs(got[:, c] - want).max(), np.abs(got[:, c] + want).max()) < 1e-7
    return got


def run(spark, vectors, kind="double", top=16):
    rows = [(k, [float(c) for c in v], "x", 1) for k, v in vectors.items()]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, x string, n int")
    return w.whiten(df, top=top).collect()


def test_against_numpy(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(200, 7)) * [9, 5, 3, 2, 1, 0.7, 0.5]
    vectors = {k: v for k, v in enumerate([*base, *base[:40]])}
    held(run(spark, vectors, top=4), vectors, 4)
    held(run(spark, vectors, top=16), vectors, 16)


def test_repeated_and_missing_eigenvalues(spark):
    cross = {2 * i + s: (2 * s - 1) * np.eye(5)[i] for i in range(5) for s in (0, 1)}
    held(run(spark, cross), cross, 16)
    flat = {k: [k % 3, 5 - k % 3, 7, k // 3] for k in range(12)}
    got = held(run(spark, flat), flat, 16)
    assert got.shape[1] == 2
    near = {0: [1.0, 0, 0], 1: [-1.0, 0, 0], 2: [0, 1.0, 0], 3: [0, -1.0, 0], 4: [0, 0, 1 + 1 / 64], 5: [0, 0, -1 - 1 / 64]}
    held(run(spark, near), near, 16)


def test_great_entries(spark):
    r = np.random.default_rng(2)
    vectors = {k: v for k, v in enumerate(r.normal(size=(30, 3)) * 1e12)}
    rows = run(spark, vectors)
    assert len(rows) == 90 and {row.deviation for row in rows} == {None} and max(row.identity_error for row in rows) < 1e-9
    assert len(run(spark, {0: [1e300, 1.0], 1: [-1e300, 2.0], 2: [0.0, 5.0]})) == 6


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 1.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [1.0, None]), (7, [-inf, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [4.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = w.whiten(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (9, 1), (9, 2)]
    assert {r.n for r in got} == {3}
    for few in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        out = w.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>"))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    held(w.op13_whitening(spark, sf).collect(), vectors, 16)
