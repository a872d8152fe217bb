"""Every stage of the pipeline against a brute-force version on a small folder of tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import pii
from tests.llm.test_llm import corpus, joined, measured, removed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    r = random.Random(12)
    long = [" ".join(f"v{r.randrange(3000)}" for _ in range(120)) for _ in range(40)]
    texts = corpus(11, 60) + long + [t + " end" for t in long[:10]] + long[:5] + [long[3] + " mail a.b@c.example.com now"]
    docs = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, len(texts), 3)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    now = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name == "packing":
            ids = {r.doc_id for r in rows}
            assert ids == set(now) and all(sum(p.length for p in rows if p.doc_id == k) == next(p.doc_tokens for p in rows if p.doc_id == k) for k in list(ids)[:20])
            break
        assert out.columns == columns
        got = {r.doc_id: r.text for r in rows}
        order = sorted(now)
        if name == "quality_rules":
            want = {k: t for k, t in now.items() if (m := measured(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
        elif name == "ngram_join":
            home = joined([now[k] for k in order])
            want = {k: now[k] for i, k in enumerate(order) if home[i][1] == i}
        elif name == "substring_dedup":
            cut = removed([now[k] for k in order])
            want = {k: cut[i][2] if cut[i][1] else now[k] for i, k in enumerate(order)}
        else:
            want = {}
            for k, t in now.items():
                spans = pii.patterns(t)
                done, parts = 0, []
                for s, kind, e in spans:
                    parts += [t[done:s], f"<{pii.KINDS[kind].upper()}>"]
                    done = e
                want[k] = "".join([*parts, t[done:]])
        assert got == want, name
        assert all(r.n_chars == len(r.text) for r in rows)
        docs, now = spark.createDataFrame(rows, docs.schema), got


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_come_back(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, c in enumerate(("spans", "n_words", "kept", "base_failed", "n_symbols", "cut_repeat_share", "n_removed", "stratum", "component_id")):
        docs = docs.withColumn(c, F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r.spans == f"0:{r.doc_id}" and r.n_words == f"1:{r.doc_id}" and r.component_id == f"8:{r.doc_id}" for r in rows), name
