"""Queries over crawl logs (derived from events): changes, skips, runs, rates, caps, streaming monitors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import history as h
from ..sources.tables import shared_folder, table
from ..streaming import monitors
from .views import CRAWL_LOG, as_crawl_log, crawl_log

NOW = "2024-01-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.changes(crawl_log(spark, sf_dir)).select("event_id", "url", "change")


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind of change, with a total row."""
    return h.changes(crawl_log(spark, sf_dir)).rollup("change").agg(F.count("*").alias("n")).select(F.coalesce("change", F.lit("total")).alias("change"), "n")


def history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log(spark, sf_dir).where("domain = 'd3' and ts between timestamp'2024-01-05' and timestamp'2024-01-12' and result = 'failed'").select("event_id", "url")


def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = crawl_log(spark, sf_dir)
    return h.skip_fresh(log.select("url").distinct(), log, _now(), 24)


def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.failure_runs(crawl_log(spark, sf_dir))


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.recovered(crawl_log(spark, sf_dir), successes=8, cool_s=3600).select("event_id", "ok_run", "may_recover")


def recent_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.keep_recent(crawl_log(spark, sf_dir), "domain", [F.desc("ts"), F.desc("event_id")], 5000).select("domain", "event_id")


def retention_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = crawl_log(spark, sf_dir)
    return h.retention(log, F.col("result") == "failed", [F.desc("ts"), F.desc("event_id")], "domain", 120).groupBy("domain", "result").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


def engine_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.capped_hits(crawl_log(spark, sf_dir), "url", "event_type", most=100)


def site_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = crawl_log(spark, sf_dir)
    return log.groupBy("domain").agg(F.count("*").alias("tasks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("url").alias("urls"), F.round(F.avg((F.col("result") == "ok").cast("int")), 6).alias("ok_rate"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


def daily_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = crawl_log(spark, sf_dir)
    return log.groupBy("domain", F.window("ts", "24 hours").alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("result") == "failed").alias("failures")).select("domain", F.col("w.start").alias("started"), "requests", "failures")


def failure_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_alerts(spark, sf_dir)
    return h.ema(daily, "domain", ["started"], F.col("failures") / F.col("requests")).select("domain", "n", F.round("ema", 8).alias("ema"))


def rate_surges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose failure rate is 1.5 times the mean of the domain's seven days before, or more."""
    daily = daily_alerts(spark, sf_dir).withColumn("rate", F.col("failures") / F.col("requests"))
    before = F.avg("rate").over(Window.partitionBy("domain").orderBy("started").rowsBetween(-7, -1))
    return daily.withColumn("before", before).where(F.col("rate") >= 1.5 * F.col("before")).select("domain", "started", F.round("rate", 8).alias("rate"))


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.throttled(crawl_log(spark, sf_dir), "domain", most=6, span="1 day")


def adjacent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.transitions(crawl_log(spark, sf_dir), "domain", ["ts", "event_id"], "result").select("event_id", "domain", "result")


def task_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 tasks; those that were running are interrupted."""
    tasks = crawl_log(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return tasks.select("event_id", F.when(F.col("event_type").isin("click", "view"), "interrupted").otherwise(F.col("event_type")).alias("state"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict per URL from structured counts: dead, unstable or alive, with the phrase that is shown."""
    per = crawl_log(spark, sf_dir).groupBy("url").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "failed").alias("f"), F.max_by("result", F.struct("ts", "event_id")).alias("last"))
    verdict = F.when(F.col("f") == F.col("n"), "dead").when((F.col("last") == "failed") & (F.col("f") * 4 >= F.col("n")), "unstable").otherwise("alive")
    return per.select("url", verdict.alias("verdict"), F.when(F.col("last") == "failed", F.concat(F.lit("failed "), F.col("f").cast("string"))).otherwise("fetched").alias("phrase"))


def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures with their attempt number (failures running) and the wait before the next one; three attempts at most."""
    log = crawl_log(spark, sf_dir)
    w = Window.partitionBy("url").orderBy("ts", "event_id")
    island = F.sum((F.col("result") == "ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    from ..functions.text import backoff

    failed = log.withColumn("island", island).where("result = 'failed'")
    attempt = F.row_number().over(Window.partitionBy("url", "island").orderBy("ts", "event_id"))
    retry_after = F.when(F.col("hash") % 2 == 0, F.col("hash"))
    return failed.withColumn("attempt", attempt.cast("long")).where("attempt <= 3").select("event_id", "attempt", backoff(F.col("attempt"), retry_after).alias("wait_s"))


def version_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each key wins, whatever the order of arrival."""
    log = crawl_log(spark, sf_dir)
    return log.groupBy("url").agg(F.max_by("hash", F.struct("ts", "event_id")).alias("hash"), F.max("ts").alias("version"))


def replay_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of requests whose outcome agrees with what the one before predicts, per domain."""
    log = crawl_log(spark, sf_dir)
    before = F.lag("result").over(Window.partitionBy("domain").orderBy("ts", "event_id"))
    return log.withColumn("said", F.coalesce(before, F.lit("ok"))).groupBy("domain").agg(F.round(F.avg(F.col("said").eqNullSafe(F.col("result")).cast("int")), 6).alias("agreement"))


def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last probe of each URL, summed up per domain, with a health percentage."""
    last = crawl_log(spark, sf_dir).groupBy("domain", "url").agg(F.max_by("result", F.struct("ts", "event_id")).alias("last"))
    return last.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("last") == "ok").alias("ok"), F.count_if(F.col("last") == "failed").alias("failed"), F.round(100 * F.avg((F.col("last") == "ok").cast("int")), 4).alias("health"))


def latest_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest purchase of each domain as a suggestion; the 50 most confident."""
    log = crawl_log(spark, sf_dir).where("event_type = 'purchase'")
    return h.keep_recent(log, "domain", [F.desc("ts"), F.desc("event_id")], 1).orderBy(F.desc("hash"), "domain").limit(50).select("domain", "event_id", "hash")


def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows by source, level and key word."""
    return crawl_log(spark, sf_dir).where(F.col("domain").isin("d1", "d2") & (F.col("result") == "failed") & F.col("url").contains("1")).select("event_id")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log(spark, sf_dir).groupBy("domain", F.session_window("ts", "3 hours").alias("w")).agg(F.count("*").alias("n")).select("domain", F.col("w.start").alias("started"), "n")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files, as a crawl log; a trigger takes 16 files at most."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    log = as_crawl_log(events.parquet(f"{sf_dir}/[e]vents.parquet"))  # a pattern may be a file or a folder, a plain path only the latter
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def run_stream(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    out = monitors.run_once(stream, f"{shared_folder(spark)}/q{uuid.uuid4().hex}", mode)
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stream(spark, monitors.alerts(events_stream(spark, sf_dir)), "complete")


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stream(spark, monitors.throttle(events_stream(spark, sf_dir), most=6, span="1 day"), "complete")


QUERIES = {f.__name__: f for f in (
    change_detection, change_counts, history_filter, incremental_skip, failure_runs, recovery, recent_urls, retention_cap, engine_hits, site_statistics, daily_alerts, failure_ema, rate_surges, throttled,
    adjacent_duplicates, task_history, verdicts, retry_queue, version_guard, replay_agreement, probe_summary, latest_suggestions, log_filter, session_windows, stream_alerts, stream_throttle,
)}

_CHANGE = f"""SELECT event_id, url, CASE WHEN result = 'failed' THEN 'failed' WHEN last IS NULL THEN 'new' WHEN last = hash THEN 'unchanged' ELSE 'updated' END AS change
FROM (SELECT *, last_value(CASE WHEN result <> 'failed' THEN hash END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {CRAWL_LOG})"""
_DAILY = f"SELECT domain, date_trunc('day', ts)::TIMESTAMP AS started, count(*) AS requests, count(*) FILTER (result = 'failed') AS failures FROM {CRAWL_LOG} GROUP BY ALL"

SQL = {
    "change_detection": _CHANGE,
    "change_counts": f"SELECT coalesce(change, 'total') AS change, count(*) AS n FROM ({_CHANGE}) GROUP BY ROLLUP (change)",
    "history_filter": f"SELECT event_id, url FROM {CRAWL_LOG} WHERE domain = 'd3' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND result = 'failed'",
    "incremental_skip": f"SELECT DISTINCT url FROM {CRAWL_LOG} WHERE url NOT IN (SELECT url FROM {CRAWL_LOG} WHERE result <> 'failed' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}')",
    "failure_runs": f"SELECT url, started, run_length FROM (SELECT url, island, min(ts) AS started, count(*) AS run_length FROM (SELECT *, sum(CASE WHEN result = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY ts, event_id) AS island FROM {CRAWL_LOG}) WHERE result = 'failed' GROUP BY ALL) WHERE run_length >= 3",
    "recovery": f"""WITH i AS (SELECT *, sum(CASE WHEN result = 'failed' THEN 1 ELSE 0 END) OVER w AS island, max(CASE WHEN result = 'failed' THEN ts END) OVER w AS bad FROM {CRAWL_LOG} WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id)),
r AS (SELECT *, (row_number() OVER (PARTITION BY domain, island ORDER BY ts, event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END)::BIGINT AS ok_run FROM i)
SELECT event_id, ok_run, ok_run >= 8 AND (bad IS NULL OR epoch_us(ts) - epoch_us(bad) >= 3600000000) AS may_recover FROM r""",
    "recent_urls": f"SELECT domain, event_id FROM {CRAWL_LOG} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) <= 5000",
    "retention_cap": f"SELECT domain, result, count(*) AS n, min(event_id) AS oldest FROM (SELECT * FROM {CRAWL_LOG} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN result = 'failed' THEN 0 ELSE 1 END, ts DESC, event_id DESC) <= 120) GROUP BY ALL",
    "engine_hits": f"WITH p AS (SELECT url, event_type, count(*) AS hits FROM {CRAWL_LOG} GROUP BY ALL), b AS (SELECT url FROM p GROUP BY url ORDER BY sum(hits) DESC, url LIMIT 100) SELECT CASE WHEN url IN (SELECT url FROM b) THEN url ELSE 'other' END AS url, event_type, sum(hits)::BIGINT AS hits FROM p GROUP BY 1, 2",
    "site_statistics": f"SELECT domain, count(*) AS tasks, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT url) AS urls, round(avg(CASE WHEN result = 'ok' THEN 1 ELSE 0 END), 6) AS ok_rate, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM {CRAWL_LOG} GROUP BY domain",
    "daily_alerts": _DAILY,
    "failure_ema": f"SELECT domain, len(a)::BIGINT AS n, round(list_reduce(a, lambda x, y: 0.3::DOUBLE * y + (1 - 0.3::DOUBLE) * x), 8) AS ema FROM (SELECT domain, list(failures::DOUBLE / requests ORDER BY started) AS a FROM ({_DAILY}) GROUP BY domain)",
    "rate_surges": f"SELECT domain, started, round(rate, 8) AS rate FROM (SELECT *, avg(rate) OVER (PARTITION BY domain ORDER BY started ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, failures::DOUBLE / requests AS rate FROM ({_DAILY}))) WHERE rate >= 1.5 * before",
    "throttled": f"SELECT domain, started, failures FROM ({_DAILY}) WHERE failures > 6",
    "adjacent_duplicates": f"SELECT event_id, domain, result FROM (SELECT *, lag(result) OVER (PARTITION BY domain ORDER BY ts, event_id) AS b FROM {CRAWL_LOG}) WHERE b IS NULL OR b <> result",
    "task_history": f"SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'interrupted' ELSE event_type END AS state FROM {CRAWL_LOG} ORDER BY ts DESC, event_id DESC LIMIT 200",
    "verdicts": f"SELECT url, CASE WHEN f = n THEN 'dead' WHEN last = 'failed' AND f * 4 >= n THEN 'unstable' ELSE 'alive' END AS verdict, CASE WHEN last = 'failed' THEN 'failed ' || f ELSE 'fetched' END AS phrase FROM (SELECT url, count(*) AS n, count(*) FILTER (result = 'failed') AS f, last(result ORDER BY ts, event_id) AS last FROM {CRAWL_LOG} GROUP BY url)",
    "retry_queue": f"""WITH i AS (SELECT *, sum(CASE WHEN result = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY ts, event_id) AS island FROM {CRAWL_LOG}),
a AS (SELECT *, row_number() OVER (PARTITION BY url, island ORDER BY ts, event_id) AS attempt FROM i WHERE result = 'failed')
SELECT event_id, attempt, least(coalesce(CASE WHEN hash % 2 = 0 THEN hash::DOUBLE END, pow(2.0::DOUBLE, attempt)), 300.0::DOUBLE) AS wait_s FROM a WHERE attempt <= 3""",
    "version_guard": f"SELECT url, last(hash ORDER BY ts, event_id) AS hash, max(ts) AS version FROM {CRAWL_LOG} GROUP BY url",
    "replay_agreement": f"SELECT domain, round(avg(CASE WHEN said = result THEN 1 ELSE 0 END), 6) AS agreement FROM (SELECT *, coalesce(lag(result) OVER (PARTITION BY domain ORDER BY ts, event_id), 'ok') AS said FROM {CRAWL_LOG}) GROUP BY domain",
    "probe_summary": f"SELECT domain, count(*) AS n, count(*) FILTER (last = 'ok') AS ok, count(*) FILTER (last = 'failed') AS failed, round(100 * avg(CASE WHEN last = 'ok' THEN 1 ELSE 0 END), 4) AS health FROM (SELECT domain, url, last(result ORDER BY ts, event_id) AS last FROM {CRAWL_LOG} GROUP BY ALL) GROUP BY domain",
    "latest_suggestions": f"SELECT domain, event_id, hash FROM (SELECT * FROM {CRAWL_LOG} WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) = 1) ORDER BY hash DESC, domain LIMIT 50",
    "log_filter": f"SELECT event_id FROM {CRAWL_LOG} WHERE domain IN ('d1', 'd2') AND result = 'failed' AND contains(url, '1')",
    "session_windows": f"""WITH g AS (SELECT domain, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY domain ORDER BY ts, event_id) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS n, event_id FROM {CRAWL_LOG}),
s AS (SELECT domain, ts, sum(n) OVER (PARTITION BY domain ORDER BY ts, event_id) AS k FROM g) SELECT domain, min(ts) AS started, count(*) AS n FROM s GROUP BY domain, k""",
    "stream_alerts": _DAILY,
    "stream_throttle": f"SELECT domain, started, failures FROM ({_DAILY}) WHERE failures > 6",
}
