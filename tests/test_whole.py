"""Queries whose results must hold every book, every character and every row that the survey asks for."""

import random

from pyspark.sql import functions as F

from quillspark.functions import codepoint
from quillspark.operators import books
from quillspark.plans import catalog
from quillspark.plans.views import chapters, crawl_log
from quillspark.sources.tables import table

SF = "/root/testdata/sf0.001"


def brute(rows):
    own = {}
    for book, no in rows:
        own.setdefault(book, []).append(no)
    out = {}
    for b, n in own.items():
        there = sorted(set(n))
        gaps = [(x + 1, y - 1) for x, y in zip(there, there[1:]) if y > x + 1]
        text = ",".join(f"{x}-{y}" if y > x else str(x) for x, y in gaps)
        out[b] = (len(n), text, sum(y - x + 1 for x, y in gaps), len(n) - len(there), there[0] > 1)
    return out


def test_chapter_gaps_of_every_book(spark):
    got = {r.book: tuple(r)[1:] for r in catalog.queries()["chapter_gaps"](spark, SF).select("book", "chapters", "missing", "missing_numbers", "repeated", "starts_late").collect()}
    assert got == brute((r.book, r.no) for r in chapters(spark, SF).collect())
    assert any(m > 800 for _, _, m, _, _ in got.values())


def test_gaps(spark):
    rows = [("a", n) for n in range(1, 1001)] + [("b", 5), ("b", 5), ("b", 2000), ("c", 3), (None, 1), (None, 3), ("far", 1), ("far", 3), ("far", 10**11)]
    df = spark.createDataFrame(rows, "book string, no long")
    assert {r.book: tuple(r)[1:] for r in books.consistency(df).collect()} == brute(rows)
    far = spark.createDataFrame([("a", 1), ("a", 3), ("a", 10**12)], "book string, no long")
    assert sorted(map(tuple, books.gaps(far).collect())) == [("a", 2, 2), ("a", 4, 10**12 - 1)]


def test_first_differences_of_whole_texts(spark):
    r = random.Random(3)
    texts = [None, "", "a", "x" * 7, "é#😀#" * 3, *["".join(r.choice("ab é😀#") for _ in range(n)) for n in (8, 199, 200, 201, 1023, 5000, 120000)]]
    rows = []
    for t in texts:
        for at in {0, 7, len(t or "") // 2, len(t or "") - 1} if t else {0}:
            rows += [(t, t), (t, t and t + "!"), (t, t and t[:at] + "%" + t[at + 1 :]), (t, t and t[:at])]
    want = lambda a, b: None if a == b else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(rows)], "k long, a string, b string")
    got = {row.k: row.at for row in df.select("k", codepoint.first_difference(F.col("a"), F.col("b")).alias("at")).collect()}
    assert got == {k: want(*p) for k, p in enumerate(rows)}
    docs = {d.doc_id: d.text for d in table(spark, SF, "documents").collect() if d.doc_id % 3 == 1}
    assert any(len(t) > 200 for t in docs.values())
    assert {d.doc_id: d.at for d in catalog.queries()["first_differences"](spark, SF).where("doc_id % 3 = 1").collect()} == {k: len(t) for k, t in docs.items()}


def test_recent_urls_and_suggestions(spark):
    log = crawl_log(spark, SF).collect()
    by = {}
    for row in sorted(log, key=lambda x: (x.ts, x.event_id), reverse=True):
        by.setdefault(row.domain, []).append(row)
    got = {tuple(x) for x in catalog.queries()["recent_urls"](spark, SF).collect()}
    assert got == {(d, x.event_id) for d, rows in by.items() for x in rows[:5000]}
    latest = {d: bought[0] for d, rows in by.items() if (bought := [x for x in rows if x.event_type == "purchase"])}
    assert len(latest) > 10
    want = sorted(((-x.hash, d, x.event_id) for d, x in latest.items()))[:50]
    assert {tuple(x) for x in catalog.queries()["latest_suggestions"](spark, SF).collect()} == {(d, e, -h) for h, d, e in want}
