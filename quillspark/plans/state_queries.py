"""Queries over task and site states, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import states as st
from ..sources.snapshots import SnapshotStore, accumulate
from ..sources.tables import shared_folder
from ..streaming import machines as m
from .log_queries import CRAWL_LOG, crawl_log, events_stream, run_stream

ORDER = ["ts", "event_id"]
_LOG = f"WITH l AS (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'ok' END AS status, event_id % 5 * 10 + event_id % 3 AS version FROM {CRAWL_LOG})"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(crawl_log(spark, sf_dir))


def with_status(log: DataFrame) -> DataFrame:
    """A crawl log with a status of which one is not terminal, and a version that does not follow the time."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("ok")
    return log.withColumn("status", status).withColumn("version", F.col("event_id") % 5 * 10 + F.col("event_id") % 3)


def terminal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.terminal_changes(_log(spark, sf_dir), "url", ORDER, "status").select("url", "event_id", "status")


def accepted_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.accepted_writes(_log(spark, sf_dir), "url", ORDER, "version").select("url", "event_id", "version")


def first_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.first_tasks(_log(spark, sf_dir), "url", ORDER).select("url", "event_id", "status")


def fast_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.fast_skips(_log(spark, sf_dir), "url", ORDER, F.col("status") != "ok").select("url", "event_id")


def fresh_entries(spark: SparkSession, sf_dir: str, ttl: float = 20.0) -> DataFrame:
    """Per URL how many requests find an entry of at most 20 seconds of age, or of a day."""
    log = st.fresh(_log(spark, sf_dir), "url", ORDER, "ts", ttl).withColumnRenamed("fresh", "short")
    log = st.fresh(log, "url", ORDER, "ts", 86400.0)
    return log.groupBy("url").agg(F.count_if("short").alias("short"), F.count_if("fresh").alias("long"), F.count("*").alias("requests"))


def log_ring(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """The last five rows of each URL, as the queue keeps them, with the cumulative cursor."""
    return st.ring(_log(spark, sf_dir), "url", ORDER, size).select("url", "event_id", "cursor")


def site_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = st.decayed_rate(_log(spark, sf_dir), "domain", F.to_date("ts"), F.col("result") == "ok")
    return rates.select("domain", "day", F.round("prior", 9).alias("prior"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task that each request belongs to: one per URL until it ends."""
    return st.task_ids(_log(spark, sf_dir), "url", ORDER, "event_id", "status").select("url", "event_id", "task")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five notices of each domain, repeated ones merged."""
    return st.notices(_log(spark, sf_dir), "domain", ORDER, ["url", "status"]).select("domain", "event_id", "url", "status", "cursor")


def _machine(spark: SparkSession, sf_dir: str, key: str, machine: m.Machine) -> DataFrame:
    return run_stream(spark, m.run(with_status(events_stream(spark, sf_dir)), key, machine), "append")


def stream_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machine(spark, sf_dir, "url", m.Terminals(ORDER))


def stream_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machine(spark, sf_dir, "url", m.Writes(ORDER))


def stream_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machine(spark, sf_dir, "url", m.Skips(ORDER))


def stream_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that find an entry of at most a day."""
    return _machine(spark, sf_dir, "url", m.Fresh(ORDER, 86_400_000_000)).where("fresh").select("url", "event_id")


def stream_cooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests within 300 s of their domain's last failure."""
    return _machine(spark, sf_dir, "domain", m.Cooling(ORDER)).where("cooling").select("domain", "event_id")


def stream_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machine(spark, sf_dir, "domain", m.Tasks(ORDER))


def stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.latest(_machine(spark, sf_dir, "url", m.Ring(ORDER, 5)), "url")


def stream_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.latest(_machine(spark, sf_dir, "domain", m.Notices(ORDER)), "domain")


def _utc(micros: str):
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def stream_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = _machine(spark, sf_dir, "domain", m.Tiers(ORDER, oks=6, cool_us=3_600_000_000))
    return tiers.select("domain", _utc("at").alias("ts"), "tier", "moved")


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machine(spark, sf_dir, "domain", m.Breaker(ORDER, fails=3)).select("domain", _utc("opened").alias("opened"), _utc("closes").alias("closes"))


def stream_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as content responses with the views of the same URL, as sign responses, of the six hours before."""
    log = events_stream(spark, sf_dir)
    signs = log.where("event_type = 'view'").select("url", "ts", F.col("event_id").alias("sign_id"))
    contents = log.where("event_type = 'click'").select("url", "ts", "event_id")
    return run_stream(spark, m.two_step(signs, contents, "url", "6 hours", "1 day").select("url", "event_id", "sign_id"), "append")


def site_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain requests, failures, first and last time, merged batch by batch into versioned snapshots; the newest one."""
    folder = f"{shared_folder(spark)}/h{uuid.uuid4().hex}"
    store = SnapshotStore(spark, f"{folder}/store", "events")
    accumulate(events_stream(spark, sf_dir), store, merged_history, f"{folder}/checkpoint").awaitTermination()
    return store.load()


def merged_history(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    new = batch.groupBy("domain").agg(F.count("*").alias("requests"), F.count_if(F.col("result") == "failed").alias("failures"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))
    both = new if old is None else new.unionByName(old)
    return both.groupBy("domain").agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


QUERIES = {f.__name__: f for f in (
    terminal_changes, accepted_writes, first_tasks, fast_skips, fresh_entries, log_ring, site_priors, tasks, notices, stream_terminals, stream_writes, stream_skips, stream_fresh, stream_cooling,
    stream_tasks, stream_ring, stream_notices, stream_tiers, stream_breaker, stream_two_step, site_history,
)}

_AGE = "epoch(ts) - epoch(lag(ts) OVER (PARTITION BY url ORDER BY ts, event_id))"
SQL = {
    "terminal_changes": f"{_LOG} SELECT url, event_id, status FROM (SELECT *, lag(status) OVER (PARTITION BY url ORDER BY ts, event_id) AS last FROM l WHERE status IN ('ok', 'failed', 'stopped')) WHERE last IS DISTINCT FROM status",
    "accepted_writes": f"{_LOG} SELECT url, event_id, version FROM l AS a WHERE NOT EXISTS (SELECT 1 FROM l AS b WHERE b.url = a.url AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.version >= a.version)",
    "first_tasks": f"{_LOG} SELECT url, event_id, status FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts, event_id) = 1",
    "fast_skips": f"{_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS k FROM l) SELECT a.url, a.event_id FROM n AS a JOIN n AS b ON b.url = a.url AND b.k BETWEEN a.k - 3 AND a.k - 1 AND b.status <> 'ok' GROUP BY a.url, a.event_id HAVING count(*) = 3",
    "fresh_entries": f"{_LOG} SELECT url, count(*) FILTER (age <= 20) AS short, count(*) FILTER (age <= 86400) AS long, count(*) AS requests FROM (SELECT url, {_AGE} AS age FROM l) GROUP BY url",
    "log_ring": f"{_LOG} SELECT url, event_id, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS cursor FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) <= 5",
    "site_priors": f"{_LOG}, d AS (SELECT domain, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (result = 'ok') AS good FROM l GROUP BY ALL) SELECT a.domain, a.day, round(sum(b.good * pow(0.5, (a.day - b.day) / 7.0)) / sum(b.n * pow(0.5, (a.day - b.day) / 7.0)), 9) AS prior FROM d AS a JOIN d AS b ON b.domain = a.domain AND b.day BETWEEN a.day - 7 AND a.day GROUP BY a.domain, a.day",
    "tasks": f"{_LOG}, b AS (SELECT *, lag(status) OVER w AS last FROM l WINDOW w AS (PARTITION BY url ORDER BY ts, event_id)) SELECT url, event_id, last_value(CASE WHEN last IS NULL OR last <> 'running' THEN event_id END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, event_id) AS task FROM b",
    "notices": f"{_LOG}, k AS (SELECT * FROM l QUALIFY lead(url || status) OVER (PARTITION BY domain ORDER BY ts, event_id) IS DISTINCT FROM url || status) SELECT domain, event_id, url, status, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS cursor FROM k QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) <= 5",
    "stream_fresh": f"{_LOG} SELECT url, event_id FROM (SELECT url, event_id, {_AGE} AS age FROM l) WHERE age <= 86400",
    "stream_cooling": f"{_LOG} SELECT domain, event_id FROM (SELECT *, max(CASE WHEN result = 'failed' THEN ts END) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM l) WHERE epoch_us(ts) - epoch_us(bad) < 300000000",
    "stream_tiers": f"""WITH RECURSIVE n AS (SELECT *, result = 'failed' AS f, epoch_us(ts) AS us, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS k FROM {CRAWL_LOG}),
r AS (SELECT domain, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, 3 AS tier, 0 AS bad, 0 AS good, 0::BIGINT AS risk, NULL::VARCHAR AS moved FROM (SELECT DISTINCT domain FROM n)
 UNION ALL SELECT domain, k, ts, tier + CASE WHEN down THEN -1 WHEN up THEN 1 ELSE 0 END, CASE WHEN f AND NOT down THEN bad + 1 ELSE 0 END, CASE WHEN f OR up THEN 0 ELSE good + 1 END, CASE WHEN f THEN us ELSE risk END, CASE WHEN down THEN 'down' WHEN up THEN 'up' END
 FROM (SELECT n.domain, n.k, n.ts, n.f, n.us, r.tier, r.bad, r.good, r.risk, n.f AND r.bad + 1 >= 3 AND r.tier > 0 AS down, NOT n.f AND r.good + 1 >= 6 AND r.tier < 3 AND n.us - r.risk >= 3600000000 AS up FROM r JOIN n ON n.domain = r.domain AND n.k = r.k + 1))
SELECT domain, ts, tier, moved FROM r WHERE moved IS NOT NULL""",
    "stream_breaker": f"""WITH RECURSIVE n AS (SELECT *, result = 'failed' AS f, epoch_us(ts) AS us, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS k FROM {CRAWL_LOG}),
r AS (SELECT domain, 0::BIGINT AS k, 0::BIGINT AS us, 0 AS bad, 0::BIGINT AS closes, false AS opens FROM (SELECT DISTINCT domain FROM n)
 UNION ALL SELECT domain, k, us, CASE WHEN inside THEN bad WHEN f AND NOT opens THEN bad + 1 ELSE 0 END, CASE WHEN opens THEN us + 600000000 ELSE closes END, opens
 FROM (SELECT n.domain, n.k, n.us, n.f, r.bad, r.closes, n.us < r.closes AS inside, n.us < r.closes OR (n.f AND r.bad + 1 >= 3) AS opens FROM r JOIN n ON n.domain = r.domain AND n.k = r.k + 1))
SELECT domain, make_timestamp(us) AS opened, make_timestamp(closes) AS closes FROM r WHERE opens""",
    "stream_two_step": f"{_LOG} SELECT b.url, b.event_id, a.event_id AS sign_id FROM l AS b JOIN l AS a ON a.url = b.url AND a.event_type = 'view' AND b.event_type = 'click' AND a.ts <= b.ts AND b.ts <= a.ts + INTERVAL 6 HOUR",
    "site_history": f"SELECT domain, count(*) AS requests, count(*) FILTER (result = 'failed')::BIGINT AS failures, min(ts) AS first_ts, max(ts) AS last_ts FROM {CRAWL_LOG} GROUP BY domain",
}
for _stream, _batch in (("terminals", "terminal_changes"), ("writes", "accepted_writes"), ("skips", "fast_skips"), ("tasks", "tasks"), ("ring", "log_ring"), ("notices", "notices")):
    SQL[f"stream_{_stream}"] = SQL[_batch]
