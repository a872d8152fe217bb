"""Positive-unlabelled learning: features by hand, the risk and its gradients in plain numpy, the prior, and held-out labels."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import quality_classifier as q


def text(r, good):
    words = ["the", "of", "river", "stone", "Walk", "morning", "and", "light", "quiet", "paper", "house", "in"]
    n = r.choice([8, 30, 90, 200])
    if good:
        return ". ".join(" ".join(r.choice(words) for _ in range(9)) for _ in range(n // 9 + 1))
    return r.choice([" ".join(f"x{r.choice(words)}{r.choice('#$%&')}{r.choice('#$%&')}" for _ in range(n)), "BUY NOW!! " * (n // 2), f"{r.choice(words)} " * n])


def rows(seed, n, prior):
    r = random.Random(seed)
    out = []
    for k in range(n):
        good = r.random() < prior
        out.append((k, text(r, good), int(good)))
    return out


def frames(spark, rows, share=0.4, seed=1):
    r = random.Random(seed)
    docs = spark.createDataFrame([(k, t, "x", 1.5) for k, t, _ in rows], "doc_id long, text string, good string, words double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if r.random() < share], "doc_id long, quality int")
    return docs, labels


def test_features_by_hand():
    x = q.features(pa.array(["The cat, the Cat! 12\nthe cat,", None, "", "ÀÉ", "a#$ " * 60]))
    f = dict(zip(q.FEATURES, x[0]))
    assert f["words"] == np.log1p(7) and f["word_length"] == 23 / 7 and f["marks"] == 3 / 7 and f["shouts"] == 1 / 7
    assert f["capitals"] == 2 / 29 and f["digits"] == 2 / 29 and f["letters"] == 18 / 29 and f["common"] == 3 / 7 and f["most_frequent"] == 3 / 7 and f["distinct"] == 4 / 7**0.8
    assert (x[1] == 0).all() and (x[2] == 0).all()
    assert x[3][q.FEATURES.index("letters")] == 1 and x[4][q.FEATURES.index("symbols")] == 2 and x[4][q.FEATURES.index("repeated")] == 1


def test_risk_against_numpy(spark):
    docs, labels = frames(spark, rows(2, 120, 0.7))
    table = q.measured(docs, labels, "doc_id", "text", "quality", 5).cache()
    model = q.learn(table)
    assert len(model.weights) == model.width
    r = np.random.default_rng(0)
    model = q.Model(model.knots, r.normal(size=model.width), 0.6)
    p = table.toPandas()
    phi, here = model.ramps(p[list(q.FEATURES)].to_numpy()), (p.positive & p.fold.isin([1, 2, 3])).to_numpy()

    def parts(w):
        z = phi @ w
        lost, won = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
        return np.array([0.6 * lost[here].mean(), won.mean() - 0.6 * won[here].mean()])

    kept, rest, kept_g, rest_g, second = q.risk(table, model, [1, 2, 3])
    assert np.allclose([kept, rest], parts(model.weights))
    for k in range(0, model.width, 7):
        e = np.zeros(model.width)
        e[k] = 1e-5
        want = (parts(model.weights + e) - parts(model.weights - e)) / 2e-5
        assert np.allclose([kept_g[k], rest_g[k]], want, atol=1e-6)
    s = 1 / (1 + np.exp(-(phi @ model.weights)))
    assert np.allclose(second, (phi * (s * (1 - s))[:, None]).T @ phi / len(phi))
    own = {f for f in p.fold[p.positive]}
    assert 0 not in own and all(zlib.crc32(str(i).encode()) % 5 == f for i, f in zip(p.id, p.fold))


@pytest.mark.parametrize("prior", [0.35, 0.8])
def test_prior_and_held_out_accuracy(spark, prior):
    all_rows = rows(5, 1500, prior)
    docs, labels = frames(spark, all_rows)
    table = q.measured(docs, labels, "doc_id", "text", "quality", 5).cache()
    model = q.learn(table)
    assert abs(model.prior - prior) < 0.12
    rest = q.risk(table, model, [1, 2, 3, 4])[1]
    assert rest > -1e-9
    truth = {k: y for k, _, y in all_rows}
    got = [(r.score, truth[r.doc_id]) for r in q.classify(docs, labels).collect() if r.held_out]
    good, bad = ([s for s, y in got if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.97


def test_bad_labels_are_never_read(spark):
    docs, labels = frames(spark, rows(6, 200, 0.7))
    only = labels.where("quality = 1")
    score = lambda l: {r.doc_id: round(r.score, 9) for r in q.classify(docs, l).collect()}
    assert score(labels) == score(only)


def test_hard_rows(spark):
    given = [(1, None), (2, ""), (None, "a b"), (3, "word " * 100_000), (3, "word " * 100_000), (4, "z" * 200_000), (5, "\n\n"), *((k, text(random.Random(k), True)) for k in range(6, 40))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, None), (None, 1), (3, None), *((k, 1) for k in range(6, 30))], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == len(given) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 5)}) == 1
    positive = {r.id for r in q.measured(docs, labels, "doc_id", "text", "quality", 5).where("positive").collect()}
    assert positive == {k for k in (2, *range(6, 30)) if zlib.crc32(str(k).encode()) % 5}
    assert {r.score for r in q.classify(docs, labels.where("false")).collect()} == {0.5}
    assert q.classify(docs.where("false"), labels).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = q.op11_quality_classifier(spark, sf).collect()
    assert len(got) == 1000 and all(r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for _, p, y in held]) > 0.95
    assert np.mean([a > b for a, _, y in held if y for b, _, x in held if not x]) > 0.98
