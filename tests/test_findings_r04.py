"""Faults found at 6 GB."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillspark.operators import books, duplicates as du


def shuffled_rows(spark, run) -> int:
    """Rows that the stages which `run` starts write to shuffles."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    args = [getattr(store, f"stageList$default${k}")() for k in range(2, 6)]

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), *args)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    run()
    return written() - before


def titled(n: int, texts: int = 1) -> list:
    """`n` long titles, all of which hold a short one, whose `texts` texts share nothing with theirs."""
    body = lambda k: ". ".join(f"{k} says {j} and some more words of it" for j in range(25))
    rows = [(k, f"The sea of {k:05d}", body(k)) for k in range(n)]
    return rows + [(10**6 + k, "Sea", body(f"short {k}")) for k in range(texts)]


def test_texts_go_to_blocks_not_to_related_titles(spark):
    """a title of 30 texts that 300 others hold; its texts go to 8 blocks, where they went to 300 titles."""
    df = spark.createDataFrame(titled(300, 30), "id long, title string, text string")
    found = []
    rows = shuffled_rows(spark, lambda: found.extend(du.same_title_other_text(df, "id", "title", "text").collect()))
    assert {r.id: r.partners for r in found} == {k: 30 if k < 10**6 else 329 for k, _, _ in titled(300, 30)}
    assert rows < 5000


def test_titles_of_several_blocks(spark, monkeypatch):
    """titles larger than a block, which hold others and are held, against all pairs."""
    r = random.Random(4)
    rows = []
    for k in range(240):
        title, pool = r.choice(["sea", "sea", "the sea", "the sea at night", "at night", "moon"]), r.choice("pq")
        rows.append((k, title, ". ".join(f"{pool}{r.randrange(200)} and some words of it" for _ in range(r.choice([25, 30, 80, 130])))))
    size = lambda x: sum(c.isalnum() for c in x)
    known = [(k, t.replace(" ", ""), size(x), {s.strip() for s in x.split(".")}) for k, t, x in rows if size(x) >= 500]
    want = {a: n for a, ta, ca, sa in known if (n := sum(a != b and (ta in tb or tb in ta) and max(ca, cb) <= 3 * min(ca, cb) and len(sa & sb) / len(sa | sb) < 0.05 for b, tb, cb, sb in known))}
    df = spark.createDataFrame(rows, "id long, title string, text string")
    for block in (300, 1000):
        monkeypatch.setattr(du, "BLOCK", block)
        assert {x.id: x.partners for x in du.same_title_other_text(df, "id", "title", "text").collect()} == want
    assert len(want) > 150


def test_guests_are_looked_up_by_parts(monkeypatch):
    """a text with many titles of a block, looked up some at a time; lists carry over to the next batch."""
    r = random.Random(6)
    hashes, titles = ([r.getrandbits(63) for _ in range(90)] for _ in range(2))
    text = lambda t: (titles[t], r.randrange(500, 4000), r.sample(hashes, r.randrange(1, 12)))
    home, guests = [text(r.randrange(20)) for _ in range(120)], [text(80 + k % 3) for k in range(9)]
    lists = {titles[80]: titles[0:20:2], titles[81]: titles[3:4], titles[82]: titles[:20] + titles[77:78]}
    table = lambda x, first: pa.table({"id": range(first, first + len(x)), "title": pa.array([t for t, _, _ in x], pa.int64()), "chars": [c for _, c, _ in x], "n": [len(s) for _, _, s in x], "set": pa.array([s for _, _, s in x], pa.list_(pa.int64()))})
    fits = lambda a, b: max(a[1], b[1]) <= 3 * min(a[1], b[1]) and len({*a[2]} & {*b[2]}) / len({*a[2]} | {*b[2]}) < 0.3
    want = {k: sum(a[0] == b[0] and k != j and fits(a, b) for j, b in enumerate(home)) for k, a in enumerate(home)}
    want |= {500 + k: 0 for k in range(9)}
    for k, g in enumerate(guests):
        for j, b in enumerate(home):
            if b[0] in lists[g[0]] and fits(g, b):
                want[500 + k] += 1
                want[j] += 1
    for looks in (1 << 20, 50, 3):
        monkeypatch.setattr(du, "LOOKS", looks)
        held = du._Home(table(home, 0), 3, 0.3)
        got = dict.fromkeys(want, 0)
        for t, bigs in lists.items():
            own = [k for k, g in enumerate(guests) if g[0] == t]
            first = pa.table({"kind": [1], "id": pa.array([None], pa.int64()), "title": [t], "chars": pa.array([None], pa.int64()), "n": pa.array([None], pa.int64()), "set": pa.array([bigs], pa.list_(pa.int64()))})
            for some in (own[:1], own[1:]):
                rows = table([guests[k] for k in some], 0).set_column(0, "id", pa.array([500 + k for k in some]))
                rows = rows.append_column("kind", pa.array([2] * len(some))).select(first.column_names)
                for x, n in zip(*held.meet(pa.concat_tables([first, rows])).to_pydict().values()):
                    got[x] += n
        for x, n in zip(*held.all().to_pydict().values()):
            got[x] += n
        assert got == want


def test_few_pieces_of_titles_are_shuffled(spark):
    """titles of which none holds another; only pieces that some title looks for are shuffled with it."""
    r = random.Random(8)
    titles = sorted({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50)) for _ in range(400)} | {"zq", "q"})
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    found = []
    rows = shuffled_rows(spark, lambda: found.extend(du.title_parts(df).collect()))
    assert {tuple(x) for x in found} == {(a, b) for a in titles for b in titles if a != b and a in b}
    spots = df.select(F.explode(F.flatten(F.array(*(du._grams(F.col("title"), k) for k in (1, 2, 6)))))).count()
    assert rows < 1.5 * spots  # counts of spots are most of it; three times as many before


def crowds(seed: int, n: int) -> list:
    """Texts of many sizes, most of which have the lines of one of a few crowds; each crowd's texts are pairs of one another."""
    r = random.Random(seed)
    lines = [[f"crowd {c} says line {k}" for k in range(r.randrange(3, 6))] for c in range(6)]
    return [(k, ". ".join([*lines[r.randrange(6)], *(f"own {k} {j}" for j in range(r.randrange(150))), *(f"word {r.randrange(300)}" for _ in range(6))])) for k in r.sample(range(10 * n), n)]


def test_files_of_pairs_are_small(spark, tmp_path, monkeypatch):
    """pairs come in an order in which columns repeat what they said, so files of them are smaller."""
    monkeypatch.setattr(books, "BLOCKS", 2)
    df = spark.createDataFrame(crowds(1, 3000), "doc_id long, text string")
    books.sharing_pairs(df).write.parquet(str(tmp_path / "pairs"))
    new = rows = 0
    for p in (tmp_path / "pairs").glob("*.parquet"):
        both = pq.read_table(p, columns=["jaccard", "containment"])
        jaccard, containment = (both.column(c).to_numpy() for c in both.column_names)
        rows += len(jaccard)
        new += sum((c[1:] != c[:-1]).sum() for c in (jaccard, containment))
    assert rows > 500_000 and new < 1.4 * rows  # 1.7 before


def test_pairs_in_order_are_the_same_pairs():
    """texts are put in order, pairs too, some at a time; none is lost or made, and the lesser id is told."""
    r = random.Random(2)
    sets = [r.sample(range(40), r.randrange(1, 15)) for _ in range(150)]
    ids = r.sample(range(10**6), 150)
    texts = pa.table({"id": ids, "n": [len(s) + r.randrange(20) for s in sets], "set": pa.array(sets, pa.list_(pa.int64()))})
    for alone in (True, False):
        x = books.Block(books.neighbours(texts.slice(0, 150 if alone else 90)))
        y = x if alone else books.Block(books.neighbours(texts.slice(90)))
        y.sort()
        ix, iy = (z.texts.column("id").to_numpy() for z in (x, y))
        assert sorted([*ix, *([] if alone else iy)]) == sorted(ids)
        want = {(ids[a], ids[b]): n for a in range(150) for b in range(150) if a != b and (alone or a < 90 <= b) and (n := len({*sets[a]} & {*sets[b]})) >= 2}
        for most in (1, 100, 10**9):
            got, parts = [], 0
            for i, j, both, up in books.in_order(x, y, books.counted(x, y, 2, alone), most):
                assert ((ix[i] < iy[j]) == up).all()
                got += zip(ix[i].tolist(), iy[j].tolist(), both.tolist())
                parts += 1
            assert len(got) == len(want) // (1 + alone) and all(want[a, b] == n for a, b, n in got) and len({frozenset(g[:2]) for g in got}) == len(got)
    assert books.neighbours(texts.slice(0, 0)).num_rows == 0
