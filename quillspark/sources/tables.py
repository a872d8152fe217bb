"""Readers and writers for the files that users of crawled text keep."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codepoint

CRAWL_LOG = "url string, domain string, ts timestamp, http_status int, latency double, bytes long, hash string, result string, error string"
LEDGER = "url string, site string, book string"
RISK_EVENT = "origin string, domain string, ts timestamp, kind string, detail string"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a session without executors of its own may do without."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith(("local[", "local")) or spark.conf.get("spark.master", "local").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again: later readers do not work it out anew."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, ends trimmed; bytes that are no UTF-8 raise when the text is read."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.expr("validate_utf8(cast(content as string))").alias("text"))


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Decoded text of wrapped code-point payloads; files without content are left out."""
    files = whole_texts(spark, path).where(F.col("path").rlike(codepoint.DATA_FILE))
    parsed = files.withColumn("p", codepoint.payload(F.col("text"))).select("path", "p.content", "p.replace").where("content <> ''")
    return codepoint.decode(parsed, "content", "replace").select("path", "decoded")


def replacement_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ctrl, hex) of `decimal,hex` lines; malformed lines are left out."""
    rows = spark.read.schema("ctrl int, hex string").option("mode", "DROPMALFORMED").csv(path)
    return rows.where("ctrl between 0 and 31 and hex rlike '^[0-9a-fA-F]{2,6}$'")


def write_replacement_csv(df: DataFrame, path: str) -> None:
    df.select("ctrl", "hex").write.mode("overwrite").csv(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (url, site, book), `#` comments skipped, http and https only, one row per url."""
    rows = spark.read.schema(LEDGER).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return rows.where(F.col("url").rlike("^https?://")).dropDuplicates(["url"])


def crawl_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a malformed line raises instead of being read as nothing."""
    return spark.read.schema(CRAWL_LOG).option("mode", "FAILFAST").json(path)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tag, message) of lines such as `[QC] message`."""
    return spark.read.text(path).select(F.regexp_extract("value", "^\\[([^\\]]+)\\]", 1).alias("tag"), F.regexp_replace("value", "^\\[[^\\]]+\\]\\s*", "").alias("message"))


def book_chapters(books: DataFrame, text_col: str = "text", id_col: str = "path") -> DataFrame:
    """(id, ord, title, body) of `## title` sections; text before the first is section 0 without a title."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), "\n## ", -1)
    each = books.select(id_col, F.posexplode(parts).alias("ord", "part"))
    body = F.regexp_replace("part", "^[^\\n]*\\n?", "")
    return each.select(id_col, "ord", F.when(F.col("ord") > 0, F.regexp_extract("part", "^([^\\n]*)", 1)).alias("title"), F.when(F.col("ord") > 0, body).otherwise(F.regexp_replace("part", "^\\n", "")).alias("body"))


def book_texts(chapters: DataFrame, id_col: str = "book") -> DataFrame:
    """One text per book from (id, ord, title, body): headed sections with a blank line between."""
    one = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body"))
    return chapters.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("s")))).alias("a")).select(id_col, F.array_join(F.transform("a", lambda x: x["s"]), "\n\n").alias("text"))


def snapshot_metrics(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chars, paragraphs, sha256, is_empty): measures of a text, never the text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return pages.select(id_col, F.length(t).cast("long").alias("chars"), F.size(F.filter(F.split(t, "\n", -1), lambda x: F.trim(x) != "")).cast("long").alias("paragraphs"), F.sha2(t, 256).alias("sha256"), (t == "").alias("is_empty"))
