"""Crawl logs and ledgers: change detection, incremental skips, failure runs, rates, capped tables.

Logs have url, domain, ts, hash, result and a tie-breaker column. Windows partition by url or
domain; a url's or a domain's log is the unit that a task sorts, and sorting spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def changes(log: DataFrame, key: str = "url", order: tuple[str, ...] = ("ts", "event_id"), hash_col: str = "hash", failed: Column | None = None) -> DataFrame:
    """`log` with change: new, updated, unchanged or failed, against the last hash that was not a failure."""
    failed = F.col("result") == "failed" if failed is None else failed
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~failed, F.col(hash_col)), ignorenulls=True).over(before)
    return log.withColumn("change", F.when(failed, "failed").when(last.isNull(), "new").when(last == F.col(hash_col), "unchanged").otherwise("updated"))


def skip_fresh(candidates: DataFrame, log: DataFrame, now: Column, hours: float, key: str = "url") -> DataFrame:
    """Candidates without a success inside the last `hours`."""
    fresh = log.where((F.col("result") != "failed") & (F.col("ts") >= now - F.make_interval(hours=F.lit(int(hours)))) & (F.col("ts") <= now)).select(key).distinct()
    return candidates.join(fresh, key, "left_anti")


def failure_runs(log: DataFrame, key: str = "url", order: tuple[str, ...] = ("ts", "event_id"), least: int = 3) -> DataFrame:
    """(key, run start, length) of maximal runs of failures of `least` or more."""
    w = Window.partitionBy(key).orderBy(*order)
    failed = (F.col("result") == "failed").cast("int")
    runs = log.withColumn("island", F.sum(1 - failed).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("result = 'failed'")
    return runs.groupBy(key, "island").agg(F.min("ts").alias("started"), F.count("*").alias("run_length")).where(F.col("run_length") >= least).drop("island")


def recovered(log: DataFrame, key: str = "domain", order: tuple[str, ...] = ("ts", "event_id"), successes: int = 30, cool_s: int = 180) -> DataFrame:
    """`log` with ok_run (successes since the last failure) and may_recover (enough of them, and the cool-down is over)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    failed = F.col("result") == "failed"
    log = log.withColumn("island", F.sum(failed.cast("int")).over(w)).withColumn("last_failure", F.max(F.when(failed, F.col("ts"))).over(w))
    run = F.row_number().over(Window.partitionBy(key, "island").orderBy(*order)) - F.when(F.col("island") > 0, 1).otherwise(0)
    cooled = F.col("last_failure").isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_failure").cast("timestamp")) >= cool_s * 1_000_000)
    return log.withColumn("ok_run", run.cast("long")).withColumn("may_recover", (F.col("ok_run") >= successes) & cooled).drop("island", "last_failure")


def keep_recent(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows per key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def retention(df: DataFrame, pending: Column, order: list[Column], key: str, cap: int) -> DataFrame:
    """Pending rows first; the quota that remains up to `cap` goes to the others in the given order."""
    return keep_recent(df, key, [pending.cast("int").desc(), *order], cap)


def capped_hits(df: DataFrame, key: str, engine: str, most: int = 100, other: str = "other") -> DataFrame:
    """Counts per key and engine; keys beyond the `most` busiest are one row per engine."""
    per = df.groupBy(key, engine).agg(F.count("*").alias("hits"))
    busy = per.groupBy(key).agg(F.sum("hits").alias("n")).orderBy(F.desc("n"), key).limit(most).select(key, F.lit(True).alias("named"))
    named = per.join(F.broadcast(busy), key, "left")  # at most `most` rows
    return named.groupBy(F.when(F.col("named"), F.col(key)).otherwise(other).alias(key), engine).agg(F.sum("hits").alias("hits"))


def ema(df: DataFrame, key: str, order: list[str], value: Column, alpha: float = 0.3) -> DataFrame:
    """The exponential moving average of a key's values in order, and the number of values: a weighted sum, the weight
    following from a value's place from the end, so no history is gathered in one row."""
    w = Window.partitionBy(key)
    placed = df.select(key, value.cast("double").alias("__v"), (F.row_number().over(w.orderBy(*[F.desc(c) for c in order])) - 1).alias("__k"), F.row_number().over(w.orderBy(*order)).alias("__i"))
    weight = F.pow(F.lit(1 - alpha), F.col("__k")) * F.when(F.col("__i") == 1, 1.0).otherwise(alpha)
    return placed.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight * F.col("__v")).alias("ema"))


def throttled(log: DataFrame, key: str, most: int, span: str = "1 minute") -> DataFrame:
    """(key, window start, failures) of windows with more than `most` failures."""
    return log.where("result = 'failed'").groupBy(F.window("ts", span).alias("w"), key).agg(F.count("*").alias("failures")).where(F.col("failures") > most).select(key, F.col("w.start").alias("started"), "failures")


def merge_ledgers(*ledgers: DataFrame, key: str = "url") -> DataFrame:
    """Union of ledgers by key: earlier ledgers win, blanks are filled from later ones, sources are collected."""
    marked = [d.withColumn("__rank", F.lit(k)) for k, d in enumerate(ledgers)]
    every = marked[0]
    for d in marked[1:]:
        every = every.unionByName(d, allowMissingColumns=True)
    columns = [c for c in every.columns if c not in (key, "__rank", "provenance")]
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("__rank")))
    return every.groupBy(key).agg(*[first(c).alias(c) for c in columns], F.array_sort(F.collect_set("provenance")).alias("provenance"))


def suffix_join(pages: DataFrame, rules: DataFrame, suffixes: Column, id_col: str, suffix_col: str = "suffix") -> DataFrame:
    """Each page with the rule of the longest suffix of its host, by an equi-join on the exploded suffixes."""
    exploded = pages.select(id_col, F.posexplode(suffixes).alias("__pos", suffix_col))
    found = exploded.join(rules, suffix_col).groupBy(id_col).agg(F.min_by(F.struct(suffix_col, *[c for c in rules.columns if c != suffix_col]), "__pos").alias("rule"))
    return pages.join(found, id_col, "left")


def transitions(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col(state))).drop("__before")
