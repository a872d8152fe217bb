"""Queries over reviews, ledgers, kinds of content, shelves and exchanged files, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codepoint, fallback, text as tx
from ..operators import shelf
from ..sources import exchange, tables
from ..sources.tables import shared_folder, table
from .log_queries import CRAWL_LOG, crawl_log
from .web_queries import _HOST, _TITLE

PROGRESS = "reader long, book long, chapter long, place long, ts timestamp"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reviewed_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules after the best suggestions of every other domain were adopted, and how many suggestions each domain keeps."""
    log = crawl_log(spark, sf_dir).withColumn("no", F.substring("domain", 2, 9).cast("int"))
    made = log.select("domain", F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("selector"), F.col("hash").alias("confidence"), F.col("event_id").alias("made"))
    rules = log.where("no % 5 > 0").select("domain", (F.col("no") % 3 > 0).alias("enabled"), F.array(F.lit("s0"), F.lit("base")).alias("content_selectors")).distinct()
    changed, left = shelf.adopt(rules, made, log.where("no % 2 = 0").select("domain"))
    counts = shelf.pending(left).groupBy("domain").agg(F.count("*").alias("waiting"))
    return counts.join(changed, "domain", "left").select("domain", "enabled", F.array_join("content_selectors", "+").alias("selectors"), "waiting")


def log_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per result of one domain inside a span of time: rows, URLs, first and last time."""
    log = shelf.log_query(crawl_log(spark, sf_dir), domain="d3", since="2024-01-05", until="2024-01-20")
    return shelf.log_stats(log).select("domain", "result", "n", "urls", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"))


def master_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sources in one ledger, with where each URL is from and how many other sites have the book."""
    p, log = table(spark, sf_dir, "pages"), crawl_log(spark, sf_dir)
    book = F.concat(F.lit("book "), (F.col("hash") % 50).cast("string"))
    return shelf.master_ledger(
        {
            "program": p.where("page_id % 4 > 0").select("url", tx.host(F.col("url")).alias("site"), F.when(F.col("page_id") % 2 == 0, tx.html_title(F.col("html"))).alias("book")),
            "shelf": log.where("event_type = 'purchase'").select("url", book.alias("book")),
            "hand": p.where("page_id % 3 = 0").select("url").unionByName(p.select(F.concat(F.lit("file:///"), "page_id").alias("url"))),
            "tested": log.where("result = 'failed'").select("url", "domain").withColumnRenamed("domain", "site"),
            "sites": log.select(F.concat(F.lit("http://"), "domain").alias("url"), F.col("domain").alias("site")),
            "crawls": log.select("url", F.lit("").alias("site"), book.alias("book")),
        }
    )


def kind_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks of four kinds, one of them switched off and one unknown."""
    kinds = shelf.Kinds("novel")
    kinds.register("novel")(lambda t: t.select("doc_id", F.length("text").cast("long").alias("value")))
    kinds.register("comic")(lambda t: t.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("value")))
    kinds.register("audio")(lambda t: t.select("doc_id", F.octet_length("text").cast("long").alias("value")))
    tasks = table(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(F.array(F.lit(None), F.lit("comic"), F.lit("audio"), F.lit("mystery")), (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"))
    return kinds.run(tasks, off=frozenset(["audio"])).select("doc_id", "kind", "status", "value")


def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress exported by three devices as JSON, imported, and merged."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("reader"), (F.col("event_id") % 7).alias("book"), F.floor("value").cast("long").alias("chapter"), (F.col("event_id") % 100).alias("place"), "ts")
    parts = []
    for k in range(3):
        path = _folder(spark, "progress")
        exchange.write_json(e.where(F.col("event_id") % 3 == k).drop("event_id").withColumn("ts", F.col("ts").cast("timestamp")), path)
        parts.append(exchange.read_json(spark, path, PROGRESS))
    return shelf.merged_progress(*parts).select("reader", "book", "chapter", "place", F.unix_micros("ts").alias("us"))


def exported_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts written to files and read again, counted by digest."""
    path = _folder(spark, "texts")
    exchange.write_texts(table(spark, sf_dir, "documents"), path, "text")
    return exchange.read_texts(spark, path).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"))


def exported_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a ledger file with comments, read again."""
    path = _folder(spark, "ledger")
    p = table(spark, sf_dir, "pages")
    exchange.write_ledger(p.select(F.concat("url", F.lit("?p="), "page_id").alias("url"), F.when(F.col("page_id") % 3 > 0, tx.host(F.col("url"))).alias("site"), F.concat(tx.html_title(F.col("html")), F.lit("\t\n\"a\" ")).alias("book")), path)
    return tables.ledger(spark, path).select("url", "site", "book")


def typo_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with wrong characters planted at both ends, put right."""
    wrong = list(tx.TYPOS)
    planted = F.element_at(F.array(*[F.lit(w) for w in [*wrong, "象限"]]), (F.col("doc_id") % (len(wrong) + 1) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.replace_table(F.concat(planted, F.coalesce("text", F.lit("")), planted), tx.TYPOS), 256).alias("sha256"))


def decoder_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as code-point streams, decoded by column functions and in batches: the digest of the one, and whether both agree."""
    points = F.lower(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-16BE")))
    stream = F.regexp_replace(points, "(.{4})", F.when(F.col("doc_id") % 2 == 0, "x$1").otherwise("\x01$1"))
    given = table(spark, sf_dir, "documents").select("doc_id", stream.alias("content"), F.create_map(F.lit("4e2d"), F.lit("\x05")).alias("replace"))
    native = lambda df: codepoint.decode(df, "content", "replace")
    batches = lambda df: fallback.decode_by_batches(df, "content", "replace", "other")
    both = batches(fallback.first_available(given, native, lambda df: fallback.decode_by_batches(df, "content", "replace")))
    return both.select("doc_id", F.sha2("decoded", 256).alias("sha256"), F.col("decoded").eqNullSafe(F.col("other")).alias("same"))


QUERIES = {f.__name__: f for f in (reviewed_suggestions, log_statistics, master_ledger, kind_results, reading_progress, exported_texts, exported_ledger, typo_tidy, decoder_ways)}

_TYPO = lambda t, pairs: t if not pairs else f"replace({_TYPO(t, pairs[:-1])}, '{pairs[-1][0]}', '{pairs[-1][1]}')"
_PLANT = "(VALUES " + ", ".join(f"({k}, '{w}')" for k, w in enumerate([*tx.TYPOS, "象限"])) + ") v(k, w)"
_BOOK = "'book ' || (hash % 50)"

SQL = {
    "reviewed_suggestions": f"""WITH s AS (SELECT domain, substr(domain, 2)::INT AS no, 's' || (event_id % 5) AS selector, max(hash) AS c, max(event_id) AS m FROM {CRAWL_LOG} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY c DESC, m DESC, selector) AS rank FROM s), d AS (SELECT domain, no, max(selector) FILTER (rank = 1) AS best, count(*) AS n FROM r GROUP BY ALL)
SELECT domain, CASE WHEN no % 5 > 0 THEN no % 3 > 0 END AS enabled, CASE WHEN no % 5 > 0 THEN CASE WHEN no % 2 > 0 THEN 's0+base' WHEN best = 's0' THEN 's0+base' ELSE best || '+s0+base' END END AS selectors,
 n - CASE WHEN no % 5 > 0 AND no % 2 = 0 THEN 1 ELSE 0 END AS waiting FROM d WHERE n > CASE WHEN no % 5 > 0 AND no % 2 = 0 THEN 1 ELSE 0 END""",
    "log_statistics": f"SELECT domain, result, count(*) AS n, count(DISTINCT url) AS urls, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM {CRAWL_LOG} WHERE domain = 'd3' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL",
    "master_ledger": f"""WITH a AS (SELECT 0 AS k, 'program' AS name, url, {_HOST} AS site, CASE WHEN page_id % 2 = 0 THEN {_TITLE} END AS book FROM pages WHERE page_id % 4 > 0
 UNION ALL SELECT 1, 'shelf', url, NULL, {_BOOK} FROM {CRAWL_LOG} WHERE event_type = 'purchase' UNION ALL SELECT 2, 'hand', url, NULL, NULL FROM pages WHERE page_id % 3 = 0
 UNION ALL SELECT 3, 'tested', url, domain, NULL FROM {CRAWL_LOG} WHERE result = 'failed' UNION ALL SELECT 4, 'sites', 'http://' || domain, domain, NULL FROM {CRAWL_LOG}
 UNION ALL SELECT 5, 'crawls', url, '', {_BOOK} FROM {CRAWL_LOG}),
n AS (SELECT url, string_agg(name, '+' ORDER BY k) AS provenance FROM (SELECT DISTINCT url, k, name FROM a) GROUP BY url),
o AS (SELECT url, coalesce(first(site ORDER BY k, site) FILTER (site <> ''), {_HOST}) AS site, first(book ORDER BY k, book) FILTER (book <> '') AS book FROM a GROUP BY url),
e AS (SELECT book, count(DISTINCT site) - 1 AS elsewhere FROM o WHERE book IS NOT NULL GROUP BY book)
SELECT url, site, book, provenance, coalesce(elsewhere, 0)::BIGINT AS elsewhere FROM o JOIN n USING (url) LEFT JOIN e USING (book)""",
    "kind_results": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'novel' WHEN 1 THEN 'comic' WHEN 2 THEN 'audio' ELSE 'mystery' END AS kind, CASE doc_id % 4 WHEN 2 THEN 'off' WHEN 3 THEN 'unknown' ELSE 'done' END AS status,
 CASE doc_id % 4 WHEN 0 THEN length(text) WHEN 1 THEN len(string_split(text, chr(10))) END::BIGINT AS value FROM documents""",
    "reading_progress": "SELECT user_id AS reader, event_id % 7 AS book, floor(value)::BIGINT AS chapter, event_id % 100 AS place, epoch_us(ts) AS us FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY ts DESC, floor(value) DESC, event_id % 100 DESC) = 1",
    "exported_texts": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n FROM documents GROUP BY 1",
    "exported_ledger": f"SELECT url || '?p=' || page_id AS url, CASE WHEN page_id % 3 > 0 THEN {_HOST} END AS site, {_TITLE} || ' \"a\" ' AS book FROM pages",
    "typo_tidy": f"SELECT doc_id, sha256({_TYPO("w || coalesce(text, '') || w", list(tx.TYPOS.items()))}) AS sha256 FROM documents JOIN {_PLANT} ON k = doc_id % {len(tx.TYPOS) + 1}",
    "decoder_ways": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, TRUE AS same FROM documents",
}
