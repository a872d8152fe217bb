"""The source audit against plain counting, and its parts: blocks, runs, merges, tiles."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from quillspark.llm import divergence as d

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """rows of (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(LOW))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = {}
        for s in [None, *sources]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def made(seed, n=300):
    r = random.Random(seed)
    words = [f"w{'abcdefghij'[k % 10]}{'xyz'[k // 10 % 3]}{'é' * (k % 4)}{chr(0x4E00 + k) if k % 5 == 0 else ''}" for k in range(60)] + ["Ärger", "ärger", "A", "a", "ſ", "K"]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None]), r.choice(["s1"] * 3 + ["s2", "s3", "S3", None, "日本"])
        text = r.choice([None, "", "1 2 3", " ".join(r.choice(words) for _ in range(r.randrange(60))), "_".join(r.choice(words).upper() for _ in range(20))])
        rows.append((lang, source, text))
    return rows + [("fr", "only", None), ("fr", "two", "rare words"), ("en", "long", "wordy " * 40_000), ("en", "one", "x" * 300_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*row, "term", 1) for row in rows], "lang string, source string, text string, term string, count int").repartition(5)


@pytest.mark.parametrize("least,top", [(1, 5), (30, 50)])
def test_against_counting(spark, least, top):
    rows = made(least)
    got = [tuple(r) for r in d.audit(frame(spark, rows), least=least, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, top)


def test_spilled_runs_and_small_tiles(spark, monkeypatch):
    """Many runs, merges ahead of the last and several tiles a language give the same rows."""
    rows = made(7)
    want = brute(rows, 3, 50)
    small = [tuple(r) for r in d.frequencies(frame(spark, rows), least=3, memory=2_000).collect()]
    assert sorted(small) == sorted(tuple(r) for r in d.frequencies(frame(spark, rows), least=3).collect())
    monkeypatch.setattr(d, "TILE", 3)
    found = list(d._tiles([]))
    assert found == []
    spread = [("en", f"s{k % 11}", f"a{chr(97 + k % 7)} common word{chr(97 + k % 3)}") for k in range(200)]
    # tasks import the module afresh, so tiles are tested in this process
    p = {}
    many = brute(spread, 3, 50)
    freq = [tuple(r) for r in d.frequencies(frame(spark, spread), least=3).collect()]
    sources = sorted({s for _, t, s, _, _ in freq if t == ""})
    used = [(t, s, c) for _, t, s, c, _ in freq if t]
    v = len({t for t, _, _ in used})
    n = Counter()
    for _, s, c in used:
        n[s] += c
    share = lambda s, c: 1 + 10**9 * (c + 5) // (n[s] + 5 * v)
    last = (len(sources) - 1) // 3
    rows = []
    for bi in range(last + 1):
        for bj in range(bi, last + 1):
            for part in (0, 1):
                inside = [(k, s) for k, s in enumerate(sources) if k // 3 in (bi, bj)]
                own = [("", k, s, share(s, 0)) for k, s in inside]
                own += sorted((t, k, "", share(s, c)) for t, s, c in used for k, x in inside if x == s and len(t) % 2 == part)
                rows += [("en", bi, bj, part, v, *x) for x in own]
    names = ["lang", "bi", "bj", "part", "v", "term", "number", "source", "p"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 5])], names=names) for k in range(0, len(rows), 5)]
    for batch in d._tiles(batches):
        for lang, s, item, value in zip(*(c.to_pylist() for c in batch.columns)):
            p[s, item] = p.get((s, item), 0) + value
    assert p == {(s, item): value for _, s, part, item, value, _ in many if part == "pair"} and want


def test_merge_of_runs():
    r = random.Random(4)
    tables, total = [], Counter()
    for _ in range(9):
        rows = sorted({(r.choice([b"", b"en"]), r.choice([b"", b"a", b"\xff", b"b" * 30]), r.choice([b"s", b"t"])) for _ in range(r.randrange(20))})
        counts = [r.randrange(1, 9) for _ in rows]
        total.update({k: c for k, c in zip(rows, counts)})
        columns = [*zip(*rows)] if rows else [(), (), ()]
        tables.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, counts, counts], d._POSTINGS)], schema=d._POSTINGS))
    want = sorted((*k, c, c) for k, c in total.items())
    for rows in (1, 2, 5, 100):
        merged = list(d.merge([d._unpack(d._pack(t)) for t in tables], rows))
        assert [tuple(x.values()) for t in merged for x in t.to_pylist()] == want
        ends = [[(x["lang"], x["term"]) for x in t.to_pylist()] for t in merged]
        assert all(set(x).isdisjoint(y) for x, y in zip(ends, ends[1:]))


def test_empty_and_clashing(spark):
    assert d.audit(frame(spark, []).where("false")).collect() == []
    df = spark.createDataFrame([("q", "s", "a b"), ("q", "t", None)], "body string, site string, tongue string").withColumn("rank", d.F.lit(1))
    got = sorted(tuple(r) for r in d.audit(df, lang="body", source="site", text="tongue", least=1).collect())
    assert set(got) == brute([("q", "s", "a b"), ("q", "t", None)], 1, 50)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 30, 50)
    assert {tuple(r) for r in d.op12_source_divergence(spark, sf).collect()} == want
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert set(duckdb.sql(d.ORACLE_SQL["op12_source_divergence"]).fetchall()) == want
