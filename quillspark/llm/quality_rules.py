"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Statistics of every text are computed in one vectorised pass. For each stratum, labelled texts
form a holdout. Its bad texts alone lay down a path: from no cutoff at all, one step after another
tightens one rule to its next cutoff that rejects bad texts still kept; the rule that gains most a
step of its grid goes first. Its good texts test the path: a step holds if the exact upper bound (Clopper and
Pearson) of the share that ALL cutoffs chosen so far reject together is `limit` at most. The
rejected sets of a path are nested, so its steps share one level (fixed sequence). A step that
fails freezes its rule, and the others go on at level delta / strata / 2**(f + 1) / C(steps, f)
after f failures, as so many places of the failures are possible; these levels add up to delta at
most. So with probability 1 - delta at least, no stratum loses more than `limit` of its good texts.
No cutoff is chosen without a labelled bad text that speaks for it.

Strata with fewer good texts than the first step needs without any rejection (251 for four strata)
are tested together, as one pooled stratum: they get the same cutoffs, and the limit holds for
their good texts taken together, in the holdout's proportions, not for each of them. If the pool is
too small as well it has no cutoffs, and a stratum without labelled texts has none.

Counts go by one aggregation to (stratum, good, cutoffs passed of each rule), 21,168 rows a stratum
at most for the given rules: the holdout is never gathered. The cutoff
table has a row per stratum and reaches the texts by a join whose strategy Spark picks by size.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is a
stratum of its own; labels without a text or with a null label count nowhere; a text labelled
twice counts as labelled good only if all its labels say so.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .words import U64, Words, chunks, covered, mix, per_doc, small_batches, span_hashes, with_field

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Rule: (SQL expression over the statistics, the cutoffs tried). A text is rejected if the statistic exceeds the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    "dup_lines_per_word": ("n_dup_lines / greatest(n_words, 1)", (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.4)),
    "long_words": ("word_chars / greatest(n_words, 1)", (8.0, 9.0, 10.0, 12.0, 15.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-5.0, -4.0, -3.5, -3.0, -2.0)),
}


def statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs`, without the text unless `keep_text`, and with the five statistics of it; columns of their names are replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in STATISTICS]
    out = [c for c in kept if keep_text or c != text_col]
    schema = with_field(docs.select(out).schema, *[(name, "long") for name in STATISTICS])

    def run(batches):
        for batch in chunks(batches, text_col):
            arrays = [batch.column(c) for c in out]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(a.astype(np.int64)) for a in _measure(batch.column(text_col)))], names=schema.names)

    return docs.select(kept).mapInArrow(run, schema)


def _measure(column) -> list[np.ndarray]:
    w = Words(column)
    n = len(w.count)
    inside = np.zeros(len(w.raw) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside)[:-1] > 0
    points = np.concatenate([[0], np.cumsum(inside & ((w.raw & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.raw])])
    # lines with a word, as (text, hash of the line)
    feed = np.flatnonzero(w.raw == 0x0A)
    line_start = np.union1d(w.at[:-1], feed + 1)
    line_start = line_start[line_start < len(w.raw)]
    line_end = np.append(line_start[1:], len(w.raw)) if len(line_start) else line_start
    line_end = line_end - ((line_end > line_start) & (w.raw[np.maximum(line_end - 1, 0)] == 0x0A)) if len(line_start) else line_end
    worded = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    doc = np.searchsorted(w.at, line_start, "right") - 1
    with np.errstate(over="ignore"):
        key = mix(span_hashes(w.raw, line_start, line_end) + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    distinct = np.unique(key, return_index=True)[1]
    dup = np.bincount(doc, minlength=n) - np.bincount(doc[distinct], minlength=n)
    # words in three-word windows that occur twice in the text
    starts, h = w.windows(3)
    with np.errstate(over="ignore"):
        key = mix(h + w.doc[starts].astype(U64) * U64(0x9E3779B97F4A7C15))
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = covered(starts[times[place] > 1], 3, len(w)) if len(w) else np.zeros(0, bool)
    return [w.count, points[w.at[1:]] - points[w.at[:-1]], symbols[w.at[1:]] - symbols[w.at[:-1]], dup, per_doc(repeated, w.first)]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def upper_bound(bad: int, n: int, level: float) -> float:
    """The exact upper confidence bound of a binomial rate: the p at which `bad` or fewer of n have probability `level`."""
    if n == 0 or bad >= n:
        return 1.0
    k = np.arange(bad + 1)
    ways = np.concatenate([[0.0], np.cumsum(np.log((n - k[:-1]) / (k[:-1] + 1)))])
    low, high = bad / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p >= 1:
            break
        logs = ways + k * math.log(p) + (n - k) * math.log1p(-p)
        tail = math.exp(logs.max()) * np.exp(logs - logs.max()).sum()
        low, high = (p, high) if tail > level else (low, p)
    return high


def chosen(levels: np.ndarray, n: np.ndarray, good: np.ndarray, grid: list[int], strata: int, limit: float, delta: float) -> list[int]:
    """Of each rule the index of its cutoff, or the grid's length for none, from the counts n of texts that exceed
    the first `levels` of a rule's ascending cutoffs."""
    bad, bad_n = levels[~good], n[~good]
    now, path = list(grid), []
    while True:
        left = (bad <= np.array(now)).all(1) if len(bad) else np.zeros(0, bool)
        best = None
        for r in range(len(grid)):
            own, times = bad[left, r], bad_n[left]
            steps = [i for i in range(now[r]) if (own == i + 1).any()]
            if steps:
                gain = max(times[own > i].sum() / (now[r] - i) for i in steps)
                if best is None or gain > best[0]:
                    best = gain, r, steps[-1]
        if best is None:
            break
        now[best[1]] = best[2]
        path.append(best[1:])
    good_levels, good_n = levels[good], n[good]
    total = int(good_n.sum())
    now, frozen = list(grid), set()
    for r, i in path:
        if r in frozen:
            continue
        tried = [i if q == r else c for q, c in enumerate(now)]
        lost = int(good_n[(good_levels > np.array(tried)).any(1)].sum())
        level = delta / strata / 2 ** (len(frozen) + 1) / math.comb(len(path), len(frozen))
        if lost <= limit * total and upper_bound(lost, total, level) <= limit:
            now = tried
        else:
            frozen.add(r)
    return now


def cutoffs(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", stratum: str = "lang", rules=RULES, limit: float = 0.02, delta: float = 0.05) -> DataFrame:
    """A row per stratum: the cutoff of each rule, null where none is safe. Texts that the base rule fails are not tested."""
    names = list(rules)
    grids = [sorted(float(c) for c in rules[r][1]) for r in names]
    passed = [sum((F.expr(rules[r][0]) > c).cast("int") for c in grid).alias(f"level_{r}") for r, grid in zip(names, grids)]
    levels = [f"level_{r}" for r in names]
    good = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__good"))
    counted = stats.where(~base_failed()).join(good, id_col).select(F.col(stratum).alias("stratum"), (F.col("__good") == 1).alias("good"), *passed).groupBy("stratum", "good", *levels).agg(F.count("*").alias("n"))
    counted = Scratch(stats.sparkSession).keep(counted)
    sizes = counted.groupBy("stratum").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("size"))
    strata = sizes.agg(F.count("*").alias("strata"))
    least = F.log(F.lit(delta / 2) / F.col("strata")) / math.log1p(-limit)
    pooled = sizes.crossJoin(F.broadcast(strata)).select("stratum", "strata", (F.col("size") < least).alias("pooled"))  # one row of strata
    units = pooled.withColumn("unit", F.when(~F.col("pooled"), F.col("stratum")))
    grouped = counted.join(units.withColumnRenamed("stratum", "__stratum"), F.col("stratum").eqNullSafe(F.col("__stratum"))).groupBy("pooled", "unit", "strata", "good", *levels).agg(F.sum("n").alias("n"))
    out = with_field(grouped.select("pooled", "unit").schema, *[(f"cut_{r}", "double") for r in names])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        columns = np.stack([table.column(c).to_numpy() for c in levels], 1)
        cuts = chosen(columns, table.column("n").to_numpy(), table.column("good").to_numpy(zero_copy_only=False), [len(g) for g in grids], table.column("strata")[0].as_py(), limit, delta)
        row = {c: pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(("pooled", "unit"), key)}
        return pa.table(row | {f"cut_{r}": pa.array([g[i] if i < len(g) else None], pa.float64()) for r, g, i in zip(names, grids, cuts)})

    found = grouped.groupBy("pooled", "unit").applyInArrow(choose, out).withColumnsRenamed({"pooled": "__pooled", "unit": "__unit"})
    same = (F.col("pooled") == F.col("__pooled")) & F.col("unit").eqNullSafe(F.col("__unit"))
    return units.join(found, same).select("stratum", *[f"cut_{r}" for r in names])


def judge(stats: DataFrame, cuts: DataFrame, stratum: str = "lang", rules=RULES) -> DataFrame:
    """`stats` with base_failed and kept."""
    rejected = F.lit(False)
    for r, (value, _) in rules.items():
        rejected = rejected | F.coalesce(F.expr(value) > F.col(f"cut_{r}"), F.lit(False))
    joined = stats.join(cuts.withColumnRenamed("stratum", "__stratum"), F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}).drop("__stratum", *[f"cut_{r}" for r in rules])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = Scratch(spark).keep(statistics(docs))  # numbers only: texts are read and measured once
    return judge(stats, cutoffs(stats, labels)).select("doc_id", *STATISTICS, "base_failed", "kept")
