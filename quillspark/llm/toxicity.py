"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

Features are computed for a whole batch in numpy: densities of lexicon words (plain, and after
undoing digit and sign substitutions and inner separators), of words of a lexicon learned from the
labelled sample (whole words, and word beginnings of 5 and 7 characters, that occur far more often
in toxic texts than chance allows), lexicon words near a second person,
second persons, capitals, shouted words, exclamations, punctuation, obfuscated words, word length.
Trees are grown on histograms with the logistic loss. No text's own label picks the words that
make its features: a text that grows the trees gets the lexicon learned from the other growing
folds, and texts of the calibrating fold teach none of it. The model is fitted on the driver from a
bounded sample: the `most` labelled rows least by a hash of their id, a documented limit; only
their dense features reach the driver (under 2.5 MB at the default). Rows held out (crc32 of the
id as text, mod `folds`, equal to 0) are never used; one further fold calibrates. Every text is
scored, whole, in one narrow pass.

Defined results: a null or empty text has zero features and gets their score; a row labelled twice
counts once, as toxic if any label says so; null labels are ignored; without usable labels of both
classes the score is the prior (0.5 without any); a null id is not held out and not learned from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .words import Words, chunks, hash_strings, small_batches, span_hashes, utf8, with_field

#: The lexicon and the second persons, in lower case; both are parameters.
LEXICON = (
    "arsehole asshole bastard bitch brainless bullshit clown coward creep cretin crap cunt degenerate dickhead disgusting dimwit douchebag dumb dumbass "
    "dumbo dunce failure fool freak fucker garbage halfwit hate hideous idiot idiotic idiots imbecile jackass jerk kys lame leech liar loser losers lowlife lunatic "
    "maggot moron moronic morons nasty numbskull parasite pathetic pig piss prick psycho pussy repulsive retard retarded rubbish scumbag scum shit shitty sicko simpleton "
    "slime slut spineless stupid sucker sucks swine thug trash twat twit ugly useless vermin vile wanker waste weirdo whore worthless wretch"
).split()
PERSONS = "you your yours yourself youre ur u ya thou tu te toi vous votre vos du dich dir dein deine ihr euch sie tú tu usted ustedes vosotros".split()
FEATURES = ("lexicon", "lexicon_undone", "near_person", "persons", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "word_length", "log_words", "lexicon_count", "learned", "learned_count")
BEGINNINGS = (5, 7)

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"@$!|*#.-_+")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_TRAIL = np.zeros(256, bool)
_TRAIL[list(b".,;:!?)]}\"'")] = True
_UNDO = np.arange(256, dtype=np.uint8)
_UNDO[65:91] += 32
for _a, _b in zip(b"0134578@$!|", b"oieastbasil"):
    _UNDO[_a] = _b
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32


def _spans_of(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true values, broken at the texts' bounds."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    before, after = np.concatenate([[False], mask[:-1]]), np.concatenate([mask[1:], [False]])
    return np.flatnonzero(mask & (~before | edge[:-1])), np.flatnonzero(mask & (~after | edge[1:])) + 1


def _stems(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; those of shorter words are the words themselves."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.append(lead, len(data))
    at = np.searchsorted(lead, start)
    return [whole, *(span_hashes(lower, start, np.minimum(end, bounds[np.minimum(at + k, len(lead))])) for k in BEGINNINGS)]


def stem_counts(column, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct stems with the numbers of toxic and of other texts that have them."""
    data, at = utf8(column)
    start, end = _spans_of(_ALPHA[data], at)
    long = end - start >= 3
    start, end, lower = start[long], end[long], _PLAIN[data]
    doc = np.searchsorted(at, start, "right") - 1
    stems = _stems(data, start, end, lower, span_hashes(lower, start, end))
    h, doc = np.concatenate(stems), np.tile(doc, len(stems))
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, y = h[first], toxic[doc[first]] > 0
    own, place = np.unique(h, return_inverse=True)
    pos = np.bincount(place, y, len(own)).astype(np.int64)
    return own, pos, np.bincount(place, minlength=len(own)) - pos


def features(column, learned: np.ndarray, lexicon=LEXICON, persons=PERSONS) -> np.ndarray:
    """A row of FEATURES for each text; `learned` holds the sorted stem hashes of the learned lexicon."""
    w = Words(column, hashed=False)
    data, n = w.raw, len(w.count)
    lex, per = np.sort(hash_strings(lexicon)), np.sort(hash_strings(persons))
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.at])
    by_doc = lambda where: np.bincount(np.searchsorted(w.at, where, "right") - 1, minlength=n)[:n]
    within = lambda h, table: table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(h) and len(table) else np.zeros(len(h), bool)
    start, end = _spans_of(_ALPHA[data], w.at)
    lower = _PLAIN[data]
    h = span_hashes(lower, start, end)
    taught = by_doc(start[np.logical_or.reduce([within(x, learned) for x in _stems(data, start, end, lower, h)])]) if len(start) else np.zeros(n, np.int64)
    hit, person = start[within(h, lex)], start[within(h, per)]
    # whole words, without trailing marks; those with digits or signs inside letters are undone
    size = w.end - w.start
    tail = w.end.copy()
    for _ in range(4):
        tail -= (tail - w.start > 1) & _TRAIL[data[tail - 1]]
    sums = lambda mask: (lambda c: c[tail] - c[w.start])(np.concatenate([[0], np.cumsum(mask)]))
    letters, odd = sums(_ALPHA[data]), sums(_DIGIT[data] | _SIGN[data])
    mixed = (letters > 0) & (odd > 0) & (letters + odd == tail - w.start) & (tail - w.start < 40)
    o_start, o_end = w.start[mixed], tail[mixed]
    undone = np.zeros(0, np.int64)
    if len(o_start):
        keep_len = o_end - o_start
        place = np.repeat(o_start, keep_len) + np.arange(int(keep_len.sum())) - np.repeat(np.cumsum(keep_len) - keep_len, keep_len)
        raw = data[place]
        word = np.repeat(np.arange(len(o_start)), keep_len)
        kept = ~np.isin(raw, np.frombuffer(b"*#.-_+", np.uint8))
        flat, word = _UNDO[raw[kept]], word[kept]
        sizes = np.bincount(word, minlength=len(o_start))
        ends = np.cumsum(sizes)
        some = sizes > 0
        undone = o_start[some][within(span_hashes(flat, (ends - sizes)[some], ends[some]), lex)]
    upper, letter = count(_UPPER[data]), count(_ALPHA[data])
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shouted = start[(end - start >= 3) & (caps[end] - caps[start] == end - start)]
    number = np.searchsorted(w.start, np.concatenate([hit, undone]), "right") - 1
    person_no = np.searchsorted(w.start, person, "right") - 1
    gap = np.full(len(number), 99)
    if len(person_no) and len(number):
        j = np.searchsorted(person_no, number)
        for q in (np.maximum(j - 1, 0), np.minimum(j, len(person_no) - 1)):
            same = w.doc[person_no[q]] == w.doc[number]
            gap = np.minimum(gap, np.where(same, np.abs(person_no[q] - number), 99))
    near = np.concatenate([hit, undone])[gap <= 5]
    words, size_sum = np.maximum(w.count, 1), np.diff(np.concatenate([[0], np.cumsum(size)])[w.first])
    per_word = lambda x: 1000.0 * x / words
    hits, und = by_doc(hit), by_doc(undone)
    return np.column_stack([
        per_word(hits), per_word(und), per_word(by_doc(near)), per_word(by_doc(person)), upper / np.maximum(letter, 1), per_word(by_doc(shouted)),
        per_word(count(data == 33)), per_word(count(_PUNCT[data])), per_word(by_doc(o_start)), size_sum / words, np.log1p(w.count), hits + und, per_word(taught), taught,
    ]).astype(np.float64)


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            a.append(v)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, cut, left, right = (np.array(a) for a in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while (inner := f[at] >= 0).any():
            i = at[inner]
            at[inner] = np.where(x[inner, f[i]] <= cut[i], left[i], right[i])
        return np.array(self.value)[at]


@dataclass
class Model:
    """Sum of trees on the log-odds scale, then the calibration's steps, joined linearly."""

    prior: float
    trees: list[Tree]
    knots: np.ndarray
    levels: np.ndarray
    learned: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.clip(0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * p if len(self.knots) else p, 0.0, 1.0)


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, rate: float, ridge: float) -> Tree:
    tree = Tree()
    todo = [(np.arange(len(x)), tree.add(0.0), 0)]
    while todo:
        rows, node, level = todo.pop()
        gs, hs = g[rows].sum(), h[rows].sum()
        tree.value[node] = float(-rate * gs / (hs + ridge))
        if level == depth or len(rows) < 2 * least:
            continue
        best = (1e-6, -1, -1)
        for f in range(x.shape[1]):
            b, m = bins[rows, f], len(edges[f]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, v, m))[:-1] for v in (g[rows], h[rows], None))
            ok = (nl >= least) & (len(rows) - nl >= least)
            gain = np.where(ok, gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge), 0.0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        _, f, cut = best
        if f < 0:
            continue
        goes = bins[rows, f] <= cut
        tree.feature[node], tree.cut[node] = f, float(edges[f][cut])
        tree.left[node], tree.right[node] = tree.add(0.0), tree.add(0.0)
        todo += [(rows[goes], tree.left[node], level + 1), (rows[~goes], tree.right[node], level + 1)]
    return tree


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; returns the ends of the blocks and their levels."""
    order = np.argsort(raw, kind="stable")
    values, at, times = np.unique(raw[order], return_index=True, return_counts=True)
    blocks: list[list[float]] = []
    for v, total, n in zip(values, np.add.reduceat(y[order].astype(float), at), times):
        blocks.append([total, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, m, _, last = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += m
            blocks[-1][3] = last
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    levels = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return knots, levels


def fit(x: np.ndarray, y: np.ndarray, calibrates: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 10, ridge: float = 1.0, bins: int = 48) -> Model:
    """Fits the trees on the rows not marked `calibrates` and the calibration on the others."""
    if len(y) == 0 or y.min() == y.max() or (grown := ~calibrates).sum() == 0 or y[grown].min() == y[grown].max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model(float(np.log(p / (1 - p))), [], np.zeros(0), np.zeros(0))
    gx, gy = x[grown], y[grown].astype(float)
    edges = []
    for f in range(x.shape[1]):
        v = np.unique(gx[:, f])
        mids = (v[1:] + v[:-1]) / 2
        edges.append(mids if len(mids) <= bins else np.unique(np.quantile(mids, np.linspace(0, 1, bins))))
    binned = np.column_stack([np.searchsorted(e, gx[:, f]) for f, e in enumerate(edges)])
    p = gy.mean()
    model = Model(float(np.log(p / (1 - p))), [], np.zeros(0), np.zeros(0))
    raw = np.full(len(gy), model.prior)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        tree = _grow(gx, binned, edges, q - gy, np.maximum(q * (1 - q), 1e-6), depth, least, rate, ridge)
        model.trees.append(tree)
        raw += tree.predict(gx)
    if calibrates.any():
        model.knots, model.levels = isotonic(model.raw(x[calibrates]), y[calibrates])
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, most: int = 20_000, lexicon_size: int = 5_000) -> Model:
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    sample = (
        labels.where(F.col(label_col).isNotNull() & (fold != 0))
        .groupBy(id_col)
        .agg((F.max(label_col) > 0).cast("int").alias("__y"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(most)
    )
    joined = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)  # at most `most` rows of two numbers
    texts = Scratch(docs.sparkSession).keep(joined.withColumn("__fold", fold.cast("int")))  # read several times
    growing = range(1, folds - 1)
    lexicons = _learn_lexicons(texts, text_col, list(growing), lexicon_size)
    learned = lexicons[None]
    names = [f"f{k}" for k in range(len(FEATURES))]

    def run(batches):
        for batch in chunks(batches, text_col):
            own = batch.column("__fold").to_numpy()
            x = np.zeros((batch.num_rows, len(FEATURES)))
            for f in np.unique(own).tolist():
                x[own == f] = features(batch.column(text_col).filter(pa.array(own == f)), lexicons[f if f in lexicons else None])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("__y"), *(pa.array(c) for c in x.T)], names=[id_col, "__y", *names])

    schema = with_field(texts.select(id_col, "__y").schema, *[(n, "double") for n in names])
    table = texts.select(id_col, "__y", "__fold", text_col).mapInArrow(run, schema).toPandas().sort_values([id_col, *names])
    calibrates = np.array([zlib.crc32(str(i).encode()) % folds == folds - 1 for i in table[id_col]], bool)
    model = fit(table[names].to_numpy(float), table["__y"].to_numpy(int), calibrates)
    model.learned = learned
    return model


def _learn_lexicons(texts: DataFrame, text_col: str, growing: list[int], size: int, least: int = 3, deviations: float = 6.0) -> dict[int | None, np.ndarray]:
    """From the growing folds (key None), and from those without one of them (its key): the `size` stems at most whose share of
    toxic texts exceeds the folds' by the most standard deviations, and by `deviations` at least."""

    def run(batches):
        for batch in chunks(batches, text_col):
            own = batch.column("__fold").to_numpy()
            for f in np.unique(own).tolist():
                part = batch.filter(pa.array(own == f))
                h, pos, neg = stem_counts(part.column(text_col), part.column("__y").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), f, np.int32)), pa.array(h.view(np.int64)), pa.array(pos), pa.array(neg)], names=["fold", "h", "pos", "neg"])

    grown = texts.where(F.col("__fold").isin(growing))
    each = grown.select(text_col, "__y", "__fold").mapInArrow(run, "fold int, h long, pos long, neg long")
    folded = each.groupBy("h").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in growing for c in ("pos", "neg")])
    enough = sum((F.col(f"pos{f}") for f in growing), F.lit(0)) >= least
    counted = Scratch(texts.sparkSession).keep(folded.where(enough))
    sizes = {r["__fold"]: (r.n, r.y) for r in grown.groupBy("__fold").agg(F.count("*").alias("n"), F.sum("__y").alias("y")).collect()}
    out = {}
    for left_out in (None, *growing):
        used = [f for f in growing if f != left_out]
        total, toxic = (sum(sizes.get(f, (0, 0))[k] for f in used) for k in (0, 1))
        if not total:
            out[left_out] = np.zeros(0, np.uint64)
            continue
        rate = toxic / total
        pos, neg = (sum((F.col(f"{c}{f}") for f in used), F.lit(0)) for c in ("pos", "neg"))
        z = (F.col("pos") - (F.col("pos") + F.col("neg")) * rate) / F.sqrt((F.col("pos") + F.col("neg")) * rate * (1 - rate) + 1e-9)
        found = counted.select("h", pos.alias("pos"), neg.alias("neg")).where((F.col("pos") >= least) & (F.col("pos") >= F.col("neg"))).withColumn("z", z)
        rows = found.where(F.col("z") >= deviations).orderBy(F.desc("z"), "h").limit(size).select("h").collect()
        out[left_out] = np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the score of each text; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)

    def run(batches):
        for batch in chunks(batches, text_col):
            yield batch.append_column(score_col, pa.array(model.score(features(batch.column(text_col), model.learned))))

    return docs.mapInArrow(run, with_field(docs.schema, (score_col, "double")))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
