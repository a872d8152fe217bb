"""Reviews, ledgers, kinds, progress, exchanged files and the two ways of decoding, on small cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import codepoint, fallback, text as tx
from quillspark.operators import shelf
from quillspark.sources import exchange, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_review(spark):
    rules = spark.createDataFrame([("a", False, ["x", "y"]), ("b", True, None), ("c", True, ["z"])], "domain string, enabled boolean, content_selectors array<string>")
    made = spark.createDataFrame([("a", "y", 9, 1), ("a", "q", 8, 2), ("b", "q", 5, 1), ("d", "q", 7, 1), ("c", "w", 3, 1)], "domain string, selector string, confidence long, made long")
    assert [r.selector for r in shelf.pending(made.where("domain = 'a'")).orderBy("rank").collect()] == ["y", "q"]
    assert shelf.pending(made, made.where("confidence > 6")).count() == 2
    changed, left = shelf.adopt(rules, made, spark.createDataFrame([("a",), ("b",), ("d",)], "domain string"))
    assert rows(changed) == [("a", False, ["y", "x"]), ("b", True, ["q"]), ("c", True, ["z"])]  # "a" stays disabled
    assert {(r.domain, r.selector) for r in left.collect()} == {("a", "q"), ("d", "q"), ("c", "w")}  # "d" has no rule and keeps its suggestion


def test_ledger_of_sources(spark):
    first = spark.createDataFrame([("https://s/1", "", "B"), ("file:///x", "f", "B")], "url string, site string, book string")
    second = spark.createDataFrame([("https://s/1", "S"), ("http://t/2", None)], "url string, site string")
    third = spark.createDataFrame([("http://t/2", "T", "B"), ("http://t/2", "T", "A")], "url string, site string, book string")
    got = rows(shelf.master_ledger({"z": first, "y": second, "x": third.where("book = 'B'")}))
    assert got == [("http://t/2", "T", "B", "y+x", 1), ("https://s/1", "S", "B", "z+y", 1)]
    assert shelf.master_ledger({"x": third}).first().book == "A"


def test_kinds(spark):
    kinds = shelf.Kinds("novel")
    kinds.register("novel")(lambda t: t.select("id", F.lit(1).alias("v")))
    tasks = spark.createDataFrame([(1, None), (2, "novel"), (3, "other")], "id int, kind string")
    assert rows(kinds.run(tasks).select("id", "kind", "status", "v")) == [(1, "novel", "done", 1), (2, "novel", "done", 1), (3, "other", "unknown", None)]
    assert rows(kinds.run(tasks, off=frozenset(["novel"])).select("id", "status")) == [(1, "off"), (2, "off"), (3, "unknown")]


def test_exchange(spark, tmp_path):
    texts = spark.createDataFrame([("a\nb\r\n",), ("",), (None,), ("中\u2028",)], "text string")
    exchange.write_texts(texts, f"{tmp_path}/t", "text")
    assert rows(exchange.read_texts(spark, f"{tmp_path}/t")) == [("",), ("",), ("a\nb\r\n",), ("中\u2028",)]
    with pytest.raises(Exception, match="separator"):
        exchange.write_texts(texts.selectExpr("concat(text, '\x1e') as text"), f"{tmp_path}/u", "text")
    ledger = spark.createDataFrame([("https://a", None, ' "B"\tc '), ("ftp://a", "x", "y")], "url string, site string, book string")
    exchange.write_ledger(ledger, f"{tmp_path}/l")
    assert rows(tables.ledger(spark, f"{tmp_path}/l")) == [("https://a", None, ' "B" c ')]
    progress = spark.createDataFrame([(1, 1, 2, None)], "reader long, book long, chapter long, place long").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    exchange.write_json(progress, f"{tmp_path}/p")
    back = exchange.read_json(spark, f"{tmp_path}/p", progress.schema)
    assert rows(shelf.merged_progress(back, progress.withColumn("chapter", F.lit(1).cast("long")))) == rows(progress)


def test_ways_of_decoding(spark):
    odd = ["", None, "x4e2d\x014e2d4e2d", "\x02xd83d;\x04ab", "\x01d83d", "\x05\x01\x05x00", "x0041x", "\x03XYZ0041", "0041\x010041", "\x01x4e2d\x1f", "xD800\x01xdfff"]
    df = spark.createDataFrame([(t,) for t in odd], "content string").withColumn("replace", F.create_map(F.lit("4e2d"), F.lit("\x05")))
    both = fallback.decode_by_batches(codepoint.decode(df, "content", "replace"), "content", "replace", "other")
    assert [(r.content, r.decoded) for r in both.collect()] == [(r.content, r.other) for r in both.collect()]
    assert fallback.first_available(df, lambda d: d.select("no_such_column"), lambda d: d.select("content")).columns == ["content"]


def test_typos(spark):
    given = spark.createDataFrame([("巳经按排象限暴发户",)], "t string").select(tx.replace_table(F.col("t"), tx.TYPOS))
    assert given.first()[0] == "已经安排象限暴发户"
