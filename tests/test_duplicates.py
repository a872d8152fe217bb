"""Groups, ledgers, restores and titles against brute force."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quillspark.operators import books, duplicates as du
from quillspark.operators.groups import connected


def roots(links):
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def test_connected(spark):
    r = random.Random(1)
    cases = [[(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(90)], [(r.randrange(400), r.randrange(400)) for _ in range(250)], [(5, 5)], []]
    for links in cases:
        df = spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long")
        assert {x.id: x.root for x in connected(df).collect()} == roots(links)


def books_of(seed, n=60):
    r = random.Random(seed)
    common = [f"every book says this {k}" for k in range(5)]
    out = []
    for k in range(n):
        s = [f"s{r.randrange(60)} of {k % 7}" for _ in range(r.randrange(0, 30))] + r.sample(common, r.randrange(6))
        out.append((k, ". ".join(s)))
    out += [(n + k, t) for k, (_, t) in enumerate(out[:9])] + [(n + 20 + k, t + ". " + ". ".join(f"extra {j}" for j in range(k))) for k, (_, t) in enumerate(out[9:18])]
    return out + [(900, None), (901, "")]


def test_alike_pairs(spark):
    given = books_of(3)
    sets = {k: frozenset(x.strip() for x in re.split(r"[.\n]+", t or "") if x.strip()) for k, t in given}
    rep = {k: min(j for j in sets if sets[j] == s) for k, s in sets.items()}
    want = {(rep[k], k, len(s)) for k, s in sets.items() if rep[k] != k and len(s) >= 3}
    for a, b in itertools.combinations(sorted(set(rep.values())), 2):
        n, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if n >= 3 and (n / both >= 0.3 or n / min(len(sets[a]), len(sets[b])) >= 0.95):
            want.add((a, b, n))
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("h", F.lit(1))
    pairs = books.duplicate_pairs(df)
    assert {(r.a, r.b, r.shared) for r in pairs.collect()} == want and len(want) > 20
    got = {r.doc_id: (r.group, r.links) for r in du.classes(df, pairs).collect()}
    root = roots([(a, b) for a, b, _ in want])
    assert got == {k: (root.get(k, k), sum(k in (a, b) for a, b, _ in want)) for k, _ in given}


def test_actions_and_ledger(spark):
    verdicts = spark.createDataFrame([(1, 2, "same"), (2, 3, "review"), (4, 5, "subset"), (6, 7, "review"), (8, 9, "none"), (10, 11, "same")], "a long, b long, verdict string")
    sizes = spark.createDataFrame([(k, c) for k, c in ((1, 500), (2, 500), (3, 900), (4, 600), (5, 700), (6, 50), (7, 40), (8, 1), (9, 1), (10, 9), (11, 9))], "id long, chars long")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    found = du.actions(verdicts, sizes, running=ids(10), approved=ids(6, 7))
    assert {(r.group, r.id, r.action) for r in found.collect()} == {(1, 1, "review"), (1, 2, "move"), (1, 3, "keep"), (4, 4, "move"), (4, 5, "keep"), (6, 6, "keep"), (6, 7, "move")}
    old = spark.createDataFrame([(1, "cleaned"), (4, "ignored"), (50, "cleaned"), (51, "open"), (52, "ignored"), (6, "open")], "group long, status string")
    state = lambda moved: {r.group: (r.status, r.to_move, r.to_review) for r in du.merged_ledger(old, found, moved).collect()}
    assert state(None) == {1: ("open", 1, 1), 4: ("ignored", 1, 0), 50: ("cleaned", 0, 0), 52: ("ignored", 0, 0), 6: ("open", 1, 0)}
    assert state(ids(2, 1, 7))[1] == ("cleaned", 0, 0) and state(ids(7))[6] == ("cleaned", 0, 0)
    none = du.actions(verdicts.where("false"), sizes)
    assert none.count() == 0 and {r.group for r in du.merged_ledger(old, none).collect()} == {1, 4, 50, 52}


def test_restores_never_overwrite(spark):
    present = ["a.txt", "b (restored 4).txt", "c", ".hidden"]
    back = ["a.txt", "a.txt", "a (restored 1).txt", "b.txt", "c", "d.txt", "d.txt", "../e.txt", "x\\y", "..", "", None]
    df = spark.createDataFrame([("f", n) for n in back] + [("g", "a.txt")], "folder string, name string")
    got = [(r.folder, r.name, r.restored) for r in du.restored_names(df, spark.createDataFrame([("f", n) for n in present], "folder string, name string")).collect()]
    new = [r for f, _, r in got if r is not None and f == "f"]
    assert len(got) == len(back) + 1 and len(new) == len(set(new)) == 7 and not set(new) & set(present)
    assert ("g", "a.txt", "a.txt") in got and "d.txt" in new and "b (restored 5).txt" in new
    assert all(r is None for _, n, r in got if n in ("../e.txt", "x\\y", "..", "", None))


def test_titles(spark):
    r = random.Random(7)
    titles = ["abc", "b", "bc", "long title here", "title", "itle h", "天地", "天", "玄黄天地宙", "abcabcabc"] + ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))) for _ in range(60)]
    titles = sorted(set(titles))
    got = {tuple(x) for x in du.title_parts(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    assert got == {(a, b) for a in titles for b in titles if a != b and a in b}


def test_same_title_other_text(spark):
    r = random.Random(9)
    rows = []
    for k in range(60):
        title = r.choice(["The Road", "the road!", "Road", "Sea", "Seaside", None, "..."])
        pool = r.choice("pqr")
        rows.append((k, title, ". ".join(f"{pool}{r.randrange(40)} and some words of it" for _ in range(r.choice([2, 30, 60, 160])))))
    rows += [(100 + k, t, x) for k, (_, t, x) in enumerate(rows[:10])] + [(200, "Sea", None)]
    norm = lambda t: re.sub(r"[^0-9a-z]", "", (t or "").lower())
    known = {k: (norm(t), len(re.sub(r"[^0-9A-Za-z]", "", x or "")), {s.strip() for s in (x or "").split(".") if s.strip()}) for k, t, x in rows}
    known = {k: v for k, v in known.items() if v[0] and v[1] >= 500}
    want = {}
    for a, (ta, ca, sa) in known.items():
        n = sum(b != a and (ta in tb or tb in ta) and max(ca, cb) <= 3 * min(ca, cb) and len(sa & sb) / len(sa | sb) < 0.05 for b, (tb, cb, sb) in known.items())
        if n:
            want[a] = n
    df = spark.createDataFrame(rows, "id2 long, title string, text string").withColumn("chars", F.lit("x"))
    assert {x.id2: x.partners for x in du.same_title_other_text(df, "id2", "title", "text").collect()} == want and want


def test_foreign_titles(spark):
    own = [("f", 1, "Red River"), ("f", 2, "Sea"), ("f", 3, "sea!"), ("g", 4, "Moon"), ("f", 5, "x"), ("f", 6, None)]
    given = [("f", 1, "Chapter 3: the sea at night"), ("f", 2, "The Sea of the red river"), ("g", 9, "red river moon"), ("f", 9, None), ("f", 9, ""), ("f", 9, "Sea, SEA"), ("h", 1, "sea")]
    books_ = spark.createDataFrame(own, "folder string, book long, title string")
    got = {tuple(r) for r in du.foreign_titles(spark.createDataFrame(given, "folder string, book long, title string"), books_).collect()}
    assert got == {("f", 1, "Chapter 3: the sea at night", "sea"), ("f", 2, "The Sea of the red river", "redriver"), ("g", 9, "red river moon", "moon"), ("f", 9, "Sea, SEA", "sea")}


def test_alike_texts_of_one_title_make_no_rows(spark, monkeypatch):
    """F8: 300 texts of one title that share most sentences; what is shuffled grows with the texts, not with their pairs."""
    same = ". ".join(f"sentence number {k} stands in all of them" for k in range(30))
    rows = [(k, "One Title", f"{same}. own {k}") for k in range(300)] + [(900 + k, "One Title!", ". ".join(f"{k} another {j} says more" for j in range(60))) for k in range(3)]
    df = spark.createDataFrame(rows, "id long, title string, text string")
    monkeypatch.setattr(books, "ROWS", 1000)
    found = du.same_title_other_text(df, "id", "title", "text")
    assert {r.id: r.partners for r in found.collect()} == {k: 3 if k < 900 else 302 for k, _, _ in rows}
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "shared" not in plan
