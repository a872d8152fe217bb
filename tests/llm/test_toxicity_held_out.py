"""Toxicity scores against the labels of rows that nothing was learned from, on given documents."""

import numpy as np

from quillspark.llm import toxicity


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in toxicity.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    score, said, toxic = (np.array(c) for c in zip(*held))
    bad, good = score[toxic == 1], score[toxic == 0]
    auc = np.mean((bad[:, None] > good) + 0.5 * (bad[:, None] == good))
    precision, recall = toxic[said == 1].mean(), said[toxic == 1].mean()
    print(len(held), len(bad), auc, precision, recall, np.mean((score - toxic) ** 2))
    assert auc > 0.97 and precision > 0.9 and recall > 0.85
