"""Suggestions under review, ledgers of many sources, kinds of content, shelves and reading progress.

All are joins and groupings over tables; none collects rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx

Executor = Callable[[DataFrame], DataFrame]


# -- review of suggestions --------------------------------------------------------------------


def pending(suggestions: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(domain, selector, confidence, made) with rank 1, 2, ... by confidence, most confident first, within a domain; rejected pairs are left out."""
    rows = suggestions if rejected is None else suggestions.join(rejected.select("domain", "selector").distinct(), ["domain", "selector"], "left_anti")
    latest = rows.groupBy("domain", "selector").agg(F.max("confidence").alias("confidence"), F.max("made").alias("made"))
    return latest.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("confidence"), F.desc("made"), "selector")))


def adopt(rules: DataFrame, suggestions: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules after the best suggestion of each named domain was adopted, and the suggestions that stay.

    A new selector stands before those that the rule has, which stay behind it as fall-backs, each once. `enabled` and all other
    fields are as they were: a disabled site stays disabled. A domain without a rule gets none, and keeps its suggestion."""
    named = pending(suggestions).where("rank = 1").join(domains.select("domain").distinct(), "domain", "left_semi").select("domain", F.col("selector").alias("__new"))
    own = F.coalesce("content_selectors", F.array().cast("array<string>"))
    merged = F.when(F.col("__new").isNull(), F.col("content_selectors")).otherwise(F.concat(F.array("__new"), F.array_remove(own, F.col("__new"))))
    changed = rules.join(named, "domain", "left").withColumn("content_selectors", F.array_distinct(merged)).select(rules.columns)
    done = named.join(rules.select("domain").distinct(), "domain", "left_semi").select("domain", F.col("__new").alias("selector"))
    return changed, suggestions.join(done, ["domain", "selector"], "left_anti")


# -- queries on a log -------------------------------------------------------------------------


def log_query(log: DataFrame, domain: str | None = None, result: str | None = None, since=None, until=None) -> DataFrame:
    """Rows of a domain, of a result, from `since` on and before `until`; what is not given does not restrict."""
    keep = [F.col(c) == v for c, v in (("domain", domain), ("result", result)) if v is not None]
    keep += [F.col("ts") >= F.lit(since)] if since is not None else []
    keep += [F.col("ts") < F.lit(until)] if until is not None else []
    return log.where(reduce(Column.__and__, keep)) if keep else log


def log_stats(log: DataFrame, by: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Rows, URLs, and first and last time of each result."""
    return log.groupBy(*by, "result").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# -- ledgers ----------------------------------------------------------------------------------


def master_ledger(sources: dict[str, DataFrame]) -> DataFrame:
    """One row per http or https url of all sources (url, site, book), in their order of priority.

    site and book are of the first source that gives them, the host stands for a missing site; `provenance` names all sources in
    their order; `elsewhere` counts the other sites that have a book of that name, which are marked, not dropped."""
    rank = {name: k for k, name in enumerate(sources)}
    parts = [df.withColumn("__rank", F.lit(rank[name])).withColumn("__name", F.lit(name)) for name, df in sources.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where(F.col("url").rlike("^https?://"))
    said = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct("__rank", c)))
    names = F.transform(F.array_sort(F.collect_set(F.struct("__rank", "__name"))), lambda x: x["__name"])
    one = rows.groupBy("url").agg(said("site").alias("site"), said("book").alias("book"), F.array_join(names, "+").alias("provenance"))
    one = one.withColumn("site", F.coalesce("site", tx.host(F.col("url"))))
    sites = one.where("book is not null").groupBy("book").agg((F.count_distinct("site") - 1).alias("elsewhere"))
    return one.join(sites, "book", "left").select("url", "site", "book", "provenance", F.coalesce("elsewhere", F.lit(0)).alias("elsewhere"))


# -- kinds of content -------------------------------------------------------------------------


class Kinds:
    """Executors by kind of content. A new kind is one registration; nothing of the other kinds knows of it."""

    def __init__(self, usual: str):
        self.usual, self.executors = usual, {}

    def register(self, kind: str) -> Callable[[Executor], Executor]:
        def keep(f: Executor) -> Executor:
            self.executors[kind] = f
            return f

        return keep

    def run(self, tasks: DataFrame, kind_col: str = "kind", off: frozenset[str] = frozenset()) -> DataFrame:
        """The results of all tasks, each by the executor of its kind (`usual` where none is given), with the kind and a status.
        Tasks of a kind that is unknown or switched off come back as they are, with the status "unknown" or "off"."""
        kind = F.coalesce(F.col(kind_col), F.lit(self.usual))
        tasks = tasks.withColumn(kind_col, kind)
        on = [k for k in self.executors if k not in off]
        done = [f(tasks.where(F.col(kind_col) == k)).withColumn(kind_col, F.lit(k)).withColumn("status", F.lit("done")) for k, f in self.executors.items() if k in on]
        rest = tasks.where(~F.col(kind_col).isin(on)).withColumn("status", F.when(F.col(kind_col).isin(list(off)), "off").otherwise("unknown"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*done, rest])


# -- shelves ----------------------------------------------------------------------------------


def merged_progress(*parts: DataFrame) -> DataFrame:
    """(reader, book, chapter, place, ts): of each reader and book the latest record of all devices, the furthest of equally late ones."""
    rows = reduce(DataFrame.unionByName, [p.select("reader", "book", "chapter", "place", "ts") for p in parts])
    latest = rows.groupBy("reader", "book").agg(F.max(F.struct("ts", "chapter", "place")).alias("p"))
    return latest.select("reader", "book", "p.chapter", "p.place", "p.ts")
