"""A quality classifier from trusted positives and unlabelled text alone.

Every text is measured once: dense features of its words, lines, marks, letters and repetitions, in
one narrow numpy pass, written as a small table. Each feature becomes ramps between the quantiles of
all texts. A linear model over the ramps minimises the non-negative risk with the logistic loss l,

    prior * mean over positives of l(z)  +  max(0, mean over all texts of l(-z) - prior * mean over positives of l(-z)),

and a ridge. Positives are the texts labelled good; all texts are the unlabelled side, and a label of
a bad text is read only to withdraw trust from a text that is also labelled good. Each iteration is one pass over the table: Spark sums risk, gradients and
the second derivatives, tables of the model's size; a Newton step with halving follows. If the
unlabelled part falls below zero, the step raises it instead, as in the published method.

The class prior is estimated the same way: scores of the positives of one fold, kept out of the fit,
and of all texts are counted in bins. The share of all texts above a score, divided by the share of
positives above it, bounds the prior from above; it is taken where the bound plus its deviation (for
`delta`) is least. Fit and estimate alternate from a half, `turns` times; the last fit has all folds.
No sample is drawn: all counts, quantiles and sums are over all rows.

Defined results: a null or empty text has zero features and gets their score; rows held out (crc32 of
the id as text, mod `folds`, equal to 0) teach no label; a text labelled twice is a positive only if
all its labels that are not null say so; without positives every score is 0.5; a null id is unlabelled and not
held out; repeated rows count again; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import quality_rules
from .scratch import Scratch
from .words import Words, chunks, hash_strings, per_doc, small_batches, with_field

#: Frequent function words of four languages, a parameter.
COMMON = (
    "the of and to in a is that for it was on are with as be at by this have from der die das und in den von zu mit ist im für auf "
    "le la les de des et en un une du que est pour dans qui par el los del las y una se por con para"
).split()
FEATURES = ("words", "word_length", "symbols", "marks", "shouts", "capitals", "digits", "letters", "common", "distinct", "most_frequent", "repeated", "duplicate_lines", "line_words")
KNOTS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
_BINS = 2000

_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(column, common=COMMON) -> np.ndarray:
    """A row of FEATURES for each text."""
    w = Words(column, lower=True)
    n, k = w.count.astype(float), len(w.count)
    _, chars, symbols, lines, repeated = quality_rules._measure(column)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.at])
    table = np.sort(hash_strings(common))
    known = table[np.minimum(np.searchsorted(table, w.hash), len(table) - 1)] == w.hash
    order = np.lexsort((w.hash, w.doc))
    h, doc = w.hash[order], w.doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    most = np.zeros(k)
    np.maximum.at(most, doc[first], times)
    distinct = np.bincount(doc[first], minlength=k)[:k]
    words, size = np.maximum(n, 1), np.maximum(np.diff(w.at), 1)
    return np.column_stack([
        np.log1p(n), chars / words, symbols / words, count(_MARK[w.raw]) / words, count(w.raw == 33) / words, count(_UPPER[w.raw]) / size, count(_DIGIT[w.raw]) / size, count(_LETTER[w.raw]) / size,
        per_doc(known, w.first) / words, distinct / np.maximum(n, 1) ** 0.8, most / words, repeated / words, lines / words, np.log1p(n / (1 + count(w.raw == 10))),
    ])


@dataclass
class Model:
    """Ramps between knots, a weight for each and one to add; `prior` as estimated."""

    knots: list[np.ndarray]
    weights: np.ndarray
    prior: float

    @property
    def width(self) -> int:
        return 1 + sum(max(len(k) - 1, 0) for k in self.knots)

    def ramps(self, x: np.ndarray) -> np.ndarray:
        out = [np.ones((len(x), 1))]
        for f, k in enumerate(self.knots):
            if len(k) > 1:
                out.append(np.clip((x[:, f, None] - k[:-1]) / (k[1:] - k[:-1]), 0.0, 1.0))
        return np.concatenate(out, 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.ramps(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _sums(table: DataFrame, kind: str, size: int, of) -> np.ndarray:
    """Spark's sums of the arrays that `of` makes of each task's (features, fold, is positive); a table of `size` numbers."""
    names = list(FEATURES)

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(c).to_numpy() for c in names])
                total += of(x, batch.column("fold").to_numpy(), batch.column("positive").to_numpy(zero_copy_only=False).astype(bool))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "v"])

    out = np.zeros(size)
    for r in table.select(*names, "fold", "positive").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def risk(table: DataFrame, model: Model, folds: list[int]):
    """The two parts of the risk at the model, their gradients and the unlabelled side's second derivatives."""
    d = model.width

    def of(x, fold, positive):
        phi = model.ramps(x)
        z = phi @ model.weights
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p = positive & np.isin(fold, folds)
        second = (phi * (s * (1 - s))[:, None]).T @ phi
        return np.concatenate([[len(x), p.sum(), _softplus(z).sum(), _softplus(z[p]).sum(), _softplus(-z[p]).sum()], s @ phi, s[p] @ phi[p], (1 - s[p]) @ phi[p], second.ravel()])

    v = _sums(table, "risk", 5 + 3 * d + d * d, of)
    n, m = max(v[0], 1), max(v[1], 1)
    all_g, pos_g, lost_g = (v[5 + k * d : 5 + (k + 1) * d] for k in range(3))
    kept, rest = model.prior * v[4] / m, v[2] / n - model.prior * v[3] / m
    return kept, rest, -model.prior * lost_g / m, all_g / n - model.prior * pos_g / m, v[5 + 3 * d :].reshape(d, d) / n


def minimise(table: DataFrame, model: Model, folds: list[int], ridge: float = 1e-3, most: int = 14, gain: float = 1e-5) -> Model:
    """The model of least non-negative risk that Newton steps from `model` find. A step that would leave the unlabelled part
    below zero is cut to a third, again and again; a start below zero (the prior has changed) is first raised."""
    penalty = np.full(model.width, ridge)
    penalty[0] = 0.0
    worth = lambda kept, rest, w: kept + max(0.0, rest) + 0.5 * float(penalty @ (w * w))
    now = risk(table, model, folds)
    best, step = worth(*now[:2], model.weights), 1.0
    for _ in range(most):
        kept, rest, kept_g, rest_g, second = now
        way = np.linalg.solve(second + np.diag(penalty + 1e-6), rest_g if rest < 0 else -(kept_g + rest_g + penalty * model.weights))
        tried = Model(model.knots, model.weights + step * way, model.prior)
        then = risk(table, tried, folds)
        value = worth(*then[:2], tried.weights)
        raised = rest < 0 and then[1] > rest
        if raised or (then[1] >= 0 and value < best):
            done = not raised and best - value < gain
            model, now, best, step = tried, then, value, min(1.0, 2 * step)
            if done:
                break
        elif (step := step / 3) < 0.003:
            break
    return model


def estimated_prior(table: DataFrame, model: Model, fold: int, delta: float = 0.1) -> float:
    """The share of positives among all texts, by the best bin of the scores of the positives of `fold`, which the fit did not see."""

    def of(x, folds, positive):
        at = np.minimum((model.score(x) * _BINS).astype(int), _BINS - 1)
        return np.concatenate([np.bincount(at, minlength=_BINS), np.bincount(at[positive & (folds == fold)], minlength=_BINS)])

    v = _sums(table, "bins", 2 * _BINS, of)
    every, kept = (np.cumsum(v[k * _BINS : (k + 1) * _BINS][::-1]) for k in (0, 1))
    n, m = every[-1], kept[-1]
    if not m:
        return model.prior
    every, kept = every / n, kept / m
    slack = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * m))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(kept > 0, (every + slack) / kept, np.inf)
    at = int(bound.argmin())
    return float(np.clip(every[at] / kept[at], 0.01, 0.99))


def measured(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int) -> DataFrame:
    """A row per text: its id, FEATURES, fold (-1 for a null id) and whether it is a trusted positive."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = with_field(rows.select("id").schema, *[(c, "double") for c in FEATURES])

    def run(batches):
        for batch in chunks(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in x.T)], names=schema.names)

    fold = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds, F.lit(-1)).cast("int")
    good = labels.select(F.col(id_col).alias("good"), F.col(label_col).alias("y")).where(fold("good") > 0).groupBy("good").agg(F.min("y").alias("y")).where("y > 0")
    x = rows.mapInArrow(run, schema)
    return x.join(good, x["id"] == good["good"], "left").select("id", *FEATURES, fold("id").alias("fold"), F.col("good").isNotNull().alias("positive"))


def learn(table: DataFrame, folds: int = 5, turns: int = 2) -> Model:
    """The model of a table from `measured`."""
    steps = list(KNOTS)
    cuts = table.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in FEATURES], F.count(F.when(F.col("positive"), 1)).alias("n")).first()
    edges = table.agg(*[f(c).alias(f"{f.__name__} {c}") for c in FEATURES for f in (F.min, F.max)]).first()
    knots = []
    for c in FEATURES:
        values = [edges[f"min {c}"], *(cuts[c] or []), edges[f"max {c}"]]
        knots.append(np.unique([v for v in values if v is not None]))
    model = Model(knots, np.zeros(0), 0.5)
    model.weights = np.zeros(model.width)
    if not cuts["n"]:
        return model
    for _ in range(turns):
        model = minimise(table, model, list(range(1, folds - 1)), most=6)
        model.prior = estimated_prior(table, model, folds - 1)
    return minimise(table, model, list(range(1, folds)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> DataFrame:
    """A row per text: its id, held_out and score."""
    table = Scratch(docs.sparkSession).keep(measured(docs, labels, id_col, text_col, label_col, folds))
    model = learn(table, folds)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(c).to_numpy() for c in FEATURES])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(batch.column("fold").to_numpy() == 0), pa.array(model.score(x))], names=[id_col, "held_out", "score"])

    schema = table.select(F.col("id").alias(id_col)).schema
    return table.mapInArrow(run, with_field(schema, ("held_out", "boolean"), ("score", "double")))


def op11_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
