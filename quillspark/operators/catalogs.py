"""Catalogs and runs of pages: when to stop, what is written already, carry-over, ledgers of duplicates, cool-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def until_repeat(pages: DataFrame, key: str, order: str, fingerprint: Column) -> DataFrame:
    """The pages of a key before the first that equals the one before it."""
    w = Window.partitionBy(key).orderBy(order)
    marked = pages.withColumn("__fp", fingerprint)
    marked = marked.withColumn("__same", F.coalesce(F.col("__fp") == F.lag("__fp").over(w), F.lit(False)).cast("int"))
    return marked.withColumn("__stop", F.max("__same").over(w)).where("__stop = 0").drop("__fp", "__same", "__stop")


def until_short(pages: DataFrame, key: str, order: str, length: Column, first_short: int = 200, short: int = 50) -> DataFrame:
    """The pages of a key up to its last: a short first page goes on once, a later page under `short` characters ends it."""
    w = Window.partitionBy(key).orderBy(order)
    marked = pages.withColumn("__n", F.row_number().over(w)).withColumn("__len", length)
    ends = (F.col("__n") > 1) & (F.col("__len") < short)
    return marked.withColumn("__stop", F.max(ends.cast("int")).over(w)).where("__stop = 0").drop("__n", "__len", "__stop")


def until_nothing_new(items: DataFrame, key: str, page: str, item: str) -> DataFrame:
    """(key, page, new): the new items of each page, up to the first page that has none."""
    first = items.groupBy(key, item).agg(F.min(page).alias("__first"))
    per = items.select(key, page).distinct().join(first.groupBy(key, F.col("__first").alias(page)).agg(F.count("*").alias("new")), [key, page], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    w = Window.partitionBy(key).orderBy(page)
    return per.withColumn("__stop", F.max((F.col("new") == 0).cast("int")).over(w)).where("__stop = 0").drop("__stop")


def written(headings: DataFrame, key: str, heading: str) -> DataFrame:
    """(key, written): chapters in a file; headings that are bare URLs do not count."""
    return headings.groupBy(key).agg(F.count_if(~F.col(heading).rlike("^https?://")).alias("written"))


def guard(written_counts: DataFrame, catalog_counts: DataFrame, key: str) -> DataFrame:
    """What to do with an existing file: one with more chapters than the catalog is another book's and gets a new name."""
    both = catalog_counts.join(written_counts, key, "left")
    n = F.coalesce("written", F.lit(0))
    return both.select(key, n.alias("written"), "catalog", F.when(n > F.col("catalog"), "new_name").when(n == F.col("catalog"), "done").otherwise("append").alias("action"))


def carry_over(new: DataFrame, old: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """New chapters with the old text where they bring none; bytes of old texts that are no UTF-8 are replaced."""
    kept = old.select(*key, F.expr(f"make_valid_utf8(cast({text} as string))").alias("__old"))
    return new.join(kept, key, "left").withColumn(text, F.coalesce(F.nullif(F.col(text), F.lit("")), "__old")).drop("__old")


def upsert(store: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, of the changes where both are as new."""
    both = store.withColumn("__from", F.lit(0)).unionByName(changes.withColumn("__from", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("__from")))
    return both.withColumn("__n", place).where("__n = 1").drop("__n", "__from")


def cooling(log: DataFrame, key: str = "domain", seconds: int = 300, own: Column | None = None) -> DataFrame:
    """`log` with cooling: whether the last failure before a row is less than `seconds` (or the key's own number) old."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("result") == "failed", F.col("ts"))).over(w)
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return log.withColumn("cooling", F.coalesce(age < (F.lit(seconds) if own is None else F.coalesce(own, F.lit(seconds))).cast("long") * 1_000_000, F.lit(False)))


def damped_parents(blocks: DataFrame, page: str = "page_id", share: float = 0.9, factor: float = 0.6) -> DataFrame:
    """`blocks` (page, block, parent, letters, score) with the score of a block damped whose child holds nearly all its letters."""
    child = blocks.groupBy(page, F.col("parent").alias("block")).agg(F.max("letters").alias("__most"))
    return blocks.join(child, [page, "block"], "left").withColumn("score", F.when(F.col("__most") >= share * F.col("letters"), F.col("score") * factor).otherwise(F.col("score"))).drop("__most")


def ledger_states(verdicts: DataFrame, approved: DataFrame | Column, ignored: DataFrame | Column) -> DataFrame:
    """State of each pair (a, b, verdict, keep): same and subset pairs are quarantined, the loser named and restorable; pairs under
    review only if approved; what is ignored stays so; a pair that keeps neither is informational. Both are tables (a, b), or
    conditions on a pair, which need no join."""
    both = verdicts
    for given, name in ((approved, "__ok"), (ignored, "__skip")):
        both = both.withColumn(name, given) if isinstance(given, Column) else both.join(given.withColumn(name, F.lit(True)), ["a", "b"], "left")
    auto = F.col("verdict").isin("same", "subset")
    state = F.when(F.col("__skip"), "ignored").when(auto | ((F.col("verdict") == "review") & F.coalesce("__ok", F.lit(False))), "quarantined").when(F.col("verdict") == "review", "review").otherwise("informational")
    keep = F.coalesce("keep", "a")
    return both.select("a", "b", state.alias("state"), F.when(state == "quarantined", F.when(keep == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("moved"))
