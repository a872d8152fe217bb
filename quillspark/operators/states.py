"""Rules over what is known of a task or a site so far, each row judged by those before it.

Every rule partitions by the task's own key and orders by the columns given, which must be unique
within a key: of rows that tie, either may come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TERMINAL = ("ok", "failed", "stopped")  # statuses that end a task


def _before(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def terminal_changes(log: DataFrame, key: str, order: list[str], status: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Rows that bring a task to another terminal status than its last one; to repeat a status changes nothing.
    Statuses that are not listed, and null ones, are passed over."""
    ended = log.where(F.col(status).isin(*terminal))
    last = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    return ended.withColumn("__last", last).where(~F.col("__last").eqNullSafe(F.col(status))).drop("__last")


def accepted_writes(log: DataFrame, key: str, order: list[str], version: str) -> DataFrame:
    """Rows whose version is above all that arrived before for the key; a null version is turned away."""
    return log.withColumn("__most", F.max(version).over(_before(key, order))).where(F.col(version).isNotNull() & (F.col("__most").isNull() | (F.col(version) > F.col("__most")))).drop("__most")


def first_tasks(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by a partial aggregate: a key asked for again is the same task. Null keys make one task."""
    return log.groupBy(key).agg(F.min_by(F.struct(*[c for c in log.columns if c != key]), F.struct(*order)).alias("__row")).select(key, "__row.*")


def task_ids(log: DataFrame, key: str, order: list[str], name: str, status: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Adds `task`: a row of a key whose task has not ended belongs to that task, any other begins one, named by its column `name`."""
    last = F.lag(F.struct(F.col(status).isin(*terminal).alias("ended"))).over(Window.partitionBy(key).orderBy(*order))
    begins = last.isNull() | F.coalesce(last["ended"], F.lit(False))
    began = F.last(F.when(F.col("__begins"), F.col(name)), ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("__begins", begins).withColumn("task", began).drop("__begins")


def notices(log: DataFrame, key: str, order: list[str], same: list[str], size: int = 5) -> DataFrame:
    """The last `size` notices of each key: of rows running that agree in the columns `same` the last one counts. `cursor` numbers a
    key's notices from its first."""
    w = Window.partitionBy(key).orderBy(*order)
    after = F.lead(F.struct(*same)).over(w)
    kept = log.withColumn("__after", after).where(~F.col("__after").eqNullSafe(F.struct(*same))).drop("__after")
    return ring(kept, key, order, size)


def fast_skips(log: DataFrame, key: str, order: list[str], failed: Column, streak: int = 3) -> DataFrame:
    """Rows whose `streak` rows just before failed, all of them."""
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(-streak, -1)
    return log.withColumn("__failed", F.sum(failed.cast("int")).over(window)).where(f"__failed = {streak}").drop("__failed")


def fresh(log: DataFrame, key: str, order: list[str], at: str, ttl: float = 20.0) -> DataFrame:
    """Adds `fresh`: whether the key's entry before is at most `ttl` seconds old, so that it may be used again."""
    age = F.timestamp_diff("MICROSECOND", F.lag(at).over(Window.partitionBy(key).orderBy(*order)), at)
    return log.withColumn("fresh", F.coalesce(age <= ttl * 1e6, F.lit(False)))


def ring(log: DataFrame, key: str, order: list[str], size: int = 500) -> DataFrame:
    """The last `size` rows of each key, with `cursor`, the number of rows of the key up to and with each: a reader goes on after
    the cursor it saw last, though older rows have left."""
    total = F.count("*").over(Window.partitionBy(key))
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("__back", back).withColumn("cursor", total - F.col("__back") + 1).where(F.col("__back") <= size).drop("__back")


def decayed_rate(log: DataFrame, key: str, day: Column, good: Column, days: int = 7, half: float = 7.0) -> DataFrame:
    """Per key and day the share of good rows over that day and the `days` before, a row's weight halving every `half` days.
    Rows are counted by day first; the window then holds `days` + 1 rows of counts."""
    daily = log.groupBy(key, day.alias("day")).agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("good"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    span = Window.partitionBy(key).orderBy("__number").rangeBetween(-days, 0)
    seen = daily.withColumn("__number", number).withColumn("__seen", F.collect_list(F.struct("__number", "n", "good")).over(span))
    total = lambda c: F.aggregate("__seen", F.lit(0.0), lambda s, x: s + x[c] * F.pow(F.lit(0.5), (F.col("__number") - x["__number"]) / half))
    return seen.select(key, "day", (total("good") / total("n")).alias("prior"))
