"""Files that users exchange: decoded texts, ledgers with comments, shelves and settings as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SEPARATOR = "\x1e"
#: Times keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_texts(df: DataFrame, path: str, text_col: str) -> None:
    """Texts in files, one record each whatever lines it has; a text that holds the separator itself fails the job."""
    checked = F.when(F.contains(F.col(text_col), F.lit(SEPARATOR)), F.raise_error(F.lit("a text holds the record separator"))).otherwise(F.coalesce(F.col(text_col), F.lit("")))
    df.select(checked.alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", SEPARATOR).text(path).withColumnRenamed("value", "text")


def write_ledger(df: DataFrame, path: str, note: str = "url, site and book, separated by tabs") -> None:
    """Tab-separated lines of (url, site, book), a comment first in each file; tabs and line breaks inside a field become blanks, other than http urls stay out."""
    field = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\\t\\r\\n]+", " ")
    rows = df.where(F.col("url").rlike("^https?://")).select(*[field(c).alias(c) for c in ("url", "site", "book")])
    # the heading of every file is its comment line
    rows.select(F.concat_ws("\t", "url", "site", "book").alias(f"# {note}")).write.option("header", True).option("quote", "").option("sep", "\x1f").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with null fields written out, so that an import finds every field."""
    df.write.options(ignoreNullFields=False, **TIMES).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of an export; a line that is no JSON of that schema fails the job instead of being read as nothing."""
    return spark.read.schema(schema).options(mode="FAILFAST", **TIMES).json(path)
