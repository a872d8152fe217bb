"""Views derived from the given tables, in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table

LETTERS = "abcdefghijklmnopqrstuvwxyz"
IDEOGRAPHS = "".join(chr(0x4E00 + k) for k in range(26))


def cjk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Latin letters written as ideographs, and garbage appended to some."""
    docs = table(spark, sf_dir, "documents")
    text = F.translate(F.lower("text"), LETTERS, IDEOGRAPHS)
    return docs.withColumn("text", F.concat(text, F.repeat(F.lit("�"), (F.col("doc_id") % 7 * 40).cast("int"))))


CJK_DOCUMENTS = f"(SELECT * REPLACE (translate(lower(text), '{LETTERS}', '{IDEOGRAPHS}') || repeat(chr(65533), CAST(doc_id % 7 * 40 AS INT)) AS text) FROM documents)"


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_crawl_log(table(spark, sf_dir, "events"))


def as_crawl_log(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.concat(F.lit("https://d"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com/"), F.col("user_id").cast("string")).alias("url"), F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string")).alias("domain"),
        "ts", F.floor(F.col("value") / 10).cast("long").alias("hash"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("result"), "event_type",
    )


CRAWL_LOG = "(SELECT event_id, 'https://d' || (user_id % 20) || '.example.com/' || user_id AS url, 'd' || (user_id % 20) AS domain, ts, CAST(floor(value / 10) AS BIGINT) AS hash, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS result, event_type FROM events)"


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: turns are chapters, with gaps and repeats."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("no"), "text")
    c = c.where("not (book % 5 = 0 and no = 3)")
    return c.unionByName(c.where("book % 7 = 0 and no = 2")).unionByName(c.where("book % 11 = 0 and no = 1").withColumn("no", F.lit(900).cast("long")))


CHAPTERS = """(WITH c AS (SELECT conv_id AS book, turn + 1 AS no, text FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn + 1 = 3))
 SELECT * FROM c UNION ALL SELECT * FROM c WHERE book % 7 = 0 AND no = 2 UNION ALL SELECT book, 900, text FROM c WHERE book % 11 = 0 AND no = 1)"""
