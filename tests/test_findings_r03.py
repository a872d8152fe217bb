"""Faults found on larger tables."""

import datetime
import hashlib
import itertools
import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import Row, functions as F

from quillspark.functions import chars, fallback, repair as rp
from quillspark.llm import ngram_join, scratch, substring_dedup
from quillspark.operators import books
from quillspark.plans import catalog
from quillspark.streaming import machines

from .test_duplicates import books_of

SF = "/root/testdata/sf0.001"


def test_replacement_maps_of_high_numbers(spark, tmp_path):
    """Numbers whose code point is a surrogate or has five digits."""
    ids = [0, 0xD7FF - 0x4E00, 0xD800 - 0x4E00, 0xDFFF - 0x4E00, 0xE000 - 0x4E00, 0x10000 - 0x4E00, 51281, 500000, 0x110000 - 0x4E00]
    spark.createDataFrame([(k,) for k in ids], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.entries, r.five, r.six) for r in catalog.queries()["replacement_maps"](spark, str(tmp_path)).collect()}
    named = lambda p: p <= 0x10FFFF and not 0xD800 <= p <= 0xDFFF
    assert got == {k: (2, chr(0x4E00 + k), chr(0x4E00 + k)) if named(0x4E00 + k) else (0, None, None) for k in ids}


def test_all_pairs_that_share_three_sentences(spark, monkeypatch):
    given = books_of(5, 90)
    sets = {k: frozenset(x.strip() for x in re.split(r"[.\n]+", t or "") if x.strip()) for k, t in given}
    rep = {k: min(j for j in sets if sets[j] == s) for k, s in sets.items()}
    want = {(rep[k], k, len(s)) for k, s in sets.items() if rep[k] != k and len(s) >= 3}
    for a, b in itertools.combinations(sorted(set(rep.values())), 2):
        if (n := len(sets[a] & sets[b])) >= 3:
            want.add((a, b, n))
    df = spark.createDataFrame(given, "doc_id long, text string")
    monkeypatch.setattr(books, "UNIT", 7)
    monkeypatch.setattr(books, "ROWS", 50)
    for words in (4, 1):
        monkeypatch.setattr(books, "WORDS", words)
        got = [(r.a, r.b, r.shared) for r in books.sharing_pairs(df).collect()]
        assert set(got) == want and len(got) == len(want)
    assert sum(n / len(sets[a] | sets[b]) < 0.3 for a, b, n in want) > 100
    assert books.sharing_pairs(df.where("false")).count() == 0


def test_pairs_that_are_not_alike_are_told(spark):
    q = catalog.queries()
    pairs = q["duplicate_pairs"](spark, SF)
    assert pairs.where("jaccard < 0.3 and containment < 0.95").count() > 0
    assert q["duplicate_verdicts"](spark, SF).where("verdict = 'none'").count() > 0
    assert q["duplicate_ledger"](spark, SF).where("state = 'informational'").count() > 0


def test_rows_of_a_key_are_held_as_columns():
    row = Row("ts", "event_id", "at", "url", "page")
    rows = [row(datetime.datetime(2024, 1, 1, 0, 0, k % 7) if k % 11 else None, 1000 - k, k % 7, "u" + str(k % 3), "long page " * 50 + str(k)) for k in range(400)]
    key = lambda r: [(r[c] is not None, r[c]) for c in ("ts", "event_id")]
    want = [{c: r[c] for c in ("ts", "event_id", "at", "url")} for r in sorted(rows, key=key)]
    assert list(machines.in_order(iter(rows), ["ts", "event_id"], ("at", "event_id", "url"))) == want
    assert [r["page"] for r in machines.in_order(iter(rows), ["event_id"], None)] == [r.page for r in sorted(rows, key=lambda r: r.event_id)]
    assert list(machines.in_order(iter([]), ["ts"], None)) == []
    mixed = [row(None, v, 0, None, None) for v in (3, 1 << 70, None, 2)]
    assert [r["event_id"] for r in machines.in_order(iter(mixed), ["event_id"], ("event_id",))] == [None, 2, 3, 1 << 70]
    tracemalloc.start()
    made = machines.in_order((row(None, k, k, "".join(["u", str(k % 20)]), f"page {k} " * 20) for k in range(50000)), ["event_id"], ("at", "event_id", "url"))
    assert next(made)["event_id"] == 0 and tracemalloc.get_traced_memory()[1] < 8_000_000  # 160 bytes a row, of which 48 stay
    tracemalloc.stop()


def test_quick_classes_hold_the_same_characters(spark):
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10200), 0x1F600, 0x10FFFF]]
    df = spark.createDataFrame([(c,) for c in every], "c string")
    given = {"marks": (chars.ranges(chars.PUNCTUATION),), "allowed": chars.ALLOWED, "cjk": (chars.CJK,), "space": (chars.SPACE,), "latin": (chars.LATIN,), "garbage": (chars.GARBAGE,)}
    for name, classes in given.items():
        for negate in (False, True):
            assert df.where(df.c.rlike(chars.quick(*classes, negate=negate)) != df.c.rlike(chars.java(*classes, negate=negate))).count() == 0, (name, negate)
    assert "[\\x{3012}-\\x{ff00}]" in chars.quick(*given["marks"], negate=True)  # most ideographs are decided first


def test_packed_words_are_not_looked_up(spark, tmp_path):
    texts = ["", " ".join(f"w{k}" for k in range(5000)), "_a b_ é1é " * 30, "é-" * 60 + "x'\\y", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.queries()["packed_bodies"](spark, str(tmp_path))
    assert {r.doc_id: r.sha256 for r in df.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() if t and len(t) >= 100 else None for k, t in enumerate(texts)}
    assert "array_position" not in df._jdf.queryExecution().toString()


def test_syllable_runs_by_pattern_and_by_automaton(spark):
    rng = random.Random(3)
    some = rp.all_syllables()
    words = ["".join(rng.choice(some) for _ in range(rng.choice((1, 1, 2, 2, 3, 5)))) for _ in range(1500)]
    words += ["".join(rng.choice("abeghinouüvxzǎēIÜNGİſé") for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    words = [w if k % 3 else w.translate(str.maketrans("aoeu", "āǒéǔ")) if k % 2 else w.upper() for k, w in enumerate(words)]
    words += [*rp.ENGLISH, "Women", "wǒmen", "lv", "LǛ", "ê", "xian" * 9, "xian" * 9 + "q", "xian" * 30, "xian" * 30 + "q", "ǖ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", rp.is_syllable_run(F.col("w")).alias("run"), rp.without_syllable_runs(F.concat(F.lit("-"), "w", F.lit(".,"), "w")).alias("t")).collect()
    assert all(r.t == ("-.," if r.run else f"-{r.w}.,{r.w}") for r in got)
    assert 500 < sum(r.run for r in got) < len(got) - 500
    assert re.compile(rp._run_pattern(())).sub("", "women xian, nihao") == " xian, "  # also with no English words


def test_decoding_by_runs_is_decoding_by_tokens(monkeypatch):
    rng = random.Random(5)
    pieces = ["x4e2d", "\x014e2d", "\x024e2d", "4e2d", "x", ";", "\x04", "\x05", "\x01", "\x02", "é", "ab", "12345", "\n", "x00e9", "\x01d"]
    given = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))), rng.choice((None, '{"\\u0001":"A"}', '{"\\u0005":"B","\\u0004":"C"}'))) for _ in range(4000)]
    assert fallback._run("x4e2dx00e9", {}) == "中é"
    runs = [fallback._decoded(*g) for g in given]
    monkeypatch.setattr(fallback, "_SURROGATE", re.compile(""))  # token by token
    assert runs == [fallback._decoded(*g) for g in given]


def test_report_drift_joins_no_text_with_itself(spark):
    df = catalog.queries()["report_drift"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert df.count() > 0 and "Exchange hashpartitioning" not in plan and "Except" not in plan


def test_steps_of_the_pipeline_give_memory_back(spark, monkeypatch):
    """A worker after each batch, the driver after each round of the join."""
    given, settled = [], []
    monkeypatch.setattr(substring_dedup, "give_back", lambda: given.append(1))
    table = pa.table({"batch": [0], "bucket": [0], "body": [bytes(8)]})
    assert substring_dedup._given(table) is table and given == [1]
    assert substring_dedup.BATCH <= 3 << 20
    settle = scratch.Scratch.settle
    monkeypatch.setattr(scratch.Scratch, "settle", lambda self: settled.append(settle(self)))
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"{text} end{k}") for k in range(4)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.join_components(docs).collect()} == {0} and settled


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """sets go to the blocks' tasks, pairs stay where they are counted, however frequent a sentence is."""
    plan = catalog.queries()["duplicate_ledger"](spark, SF)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    above = physical[: physical.index("MapInArrow")]
    assert "Exchange" not in above and "Join" not in above and "Window" not in plan
    monkeypatch.setattr(books, "ROWS", 1000)
    texts = pa.table({"id": range(300), "set": [[1, 2, 3, 10 + k] for k in range(300)]})
    x = books.Block(texts)
    x.sort()
    parts = [len(i) for i, _, _ in books.counted(x, x, 3, True)]
    assert sum(parts) == 300 * 299 // 2 and max(parts) <= 1000
