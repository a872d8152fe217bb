"""Column functions against plain Python on fixed and random texts."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import chars, codepoint, quality, text as tx
from quillspark.operators import books, history
from quillspark.sources import tables



def in_class(c, classes):
    return any(a <= ord(c) <= b for cls in classes for a, b in cls)


def strip(t):
    while t and in_class(t[0], [chars.SPACE]):
        t = t[1:]
    while t and in_class(t[-1], [chars.SPACE]):
        t = t[:-1]
    return t


def expected_stats(t):
    if not strip(t):
        return 0, 0, 0.0, 1.0, 1.0, 0.0, 0.0
    n = len(t)
    run = total = 0
    for c in t + "\n":
        if in_class(c, chars.ALLOWED):
            total += run if run >= 4 else 0
            run = 0
        else:
            run += 1
    lines = [x for x in map(strip, t.split("\n")) if x]
    feeds = t.count("\n")
    garbage = sum(in_class(c, [chars.GARBAGE]) for c in t) + total
    return (
        n, len(lines), sum(in_class(c, [chars.CJK]) for c in t) / n, garbage / n, 1.0 - len(set(lines)) / len(lines) if lines else 1.0,
        sum(c in chars.PUNCTUATION for c in t) / n, (feeds + 1 - len(lines)) / (feeds + 1) if feeds else 0.0,
    )


def test_quality_statistics(spark):
    r = random.Random(5)
    texts = ["", "   ", "　\n\t", "短", "中文" * 300 + "。", "�" * 10, "a,b.c" * 40] + ["".join(r.choice("中文字a1 ，。\n\t�é😀#　") for _ in range(r.randrange(80))) for _ in range(300)]
    rows = quality.with_report(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    for row, t in zip(rows, texts):
        assert (row.net, row.lines, row.cjk, row.garble, row.dup, row.punct, row.blank) == expected_stats(t), repr(t)
        if not strip(t):
            assert (row.score, row.valid, row.reasons) == (0.0, False, ["正文为空"])


def test_quality_thresholds(spark):
    base = "".join(chr(0x4E00 + k % 500) for k in range(480)) + "，" * 20
    cases = [base, base[:-1], base[:200], base[:199], base + "\n" + base]
    rows = quality.with_report(spark.createDataFrame(list(enumerate(cases)), "id int, text string")).orderBy("id").collect()
    assert [r.s_length for r in rows][:4] == [25.0, 24.9, 0.0, 0.0]
    assert rows[0].score == 100.0 and rows[0].valid and rows[0].reasons == []
    assert rows[2].reasons[0] == "长度不足(200字)" and not rows[2].valid


def expected_decoding(content, mapping):
    out, pending, i = [], False, 0
    while i < len(content):
        token = re.match(r"(?s)x[0-9a-fA-F]{4}|[0-9a-fA-F]{4}|.", content[i:]).group()
        i += len(token)
        was, pending = pending, False
        if len(token) >= 4:
            digits, value = token[-4:], int(token[-4:], 16)
            good = not 0xD800 <= value <= 0xDFFF
            if len(token) == 5:
                out.append(chr(value) if good else digits if was else token)
            else:
                out.append(chr(value) if was and good else digits)
        elif token in mapping:
            out.append(mapping[token])
        elif token in "\x01\x02\x03":
            pending = True
        elif token == "\x04":
            out.append("\n")
        elif token != ";" and token >= " ":
            out.append(token)
    return "".join(out)


def test_codepoint_decoding(spark):
    r = random.Random(6)
    texts = ["", "x12345678", "\x014e2d", "x4e2d", "\x01xd800", "xd800", "\x02d800", "\x01\x02;4e2d", "ab;c\x04d", "\x054e2d"]
    texts += ["".join(r.choice(["x", "4e2d", "d8ff", "\x01", "\x02", "\x04", "\x05", ";", "a", "f", "中", "😀", "\n", " "]) for _ in range(r.randrange(30))) for _ in range(500)]
    replace = {"6587": "\x05", "41": "\x02", "zz": "\x06", "d800": "\x07", "5b57": "\x05", "1f600": "\x06"}
    df = spark.createDataFrame([(k, t, replace) for k, t in enumerate(texts)], "id int, content string, replace map<string,string>")
    mapping = {"\x05": chr(0x6587), "\x02": "A", "\x06": "😀"}
    for row in codepoint.decode(df, "content", "replace").collect():
        assert row.decoded == expected_decoding(row.content, mapping), repr(row.content)
    plain = codepoint.decode(df, "content").collect()
    assert all(row.decoded == expected_decoding(row.content, {}) for row in plain)


def test_payload_with_raw_controls(spark):
    raw = 'cb({"content": "\x01x4e2d", "replace": {"41": "\x05"}})  '
    row = spark.createDataFrame([(raw,), ("no call",)], "raw string").select(codepoint.payload(F.col("raw")).alias("p")).collect()
    assert row[0].p.content == "\x01x4e2d" and row[0].p.replace == {"41": "\x05"}
    assert row[1].p.content is None and row[1].p.replace == {}


def test_text_functions(spark):
    def one(column, value, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]

    assert one(tx.rebuild_paragraphs, "a \n\n\n b\nc\n\n") == "a\n\nb\nc"
    assert one(tx.merge_short_lines, "这是一行\n没有结束\n结束了。\n新行") == "这是一行没有结束结束了。\n新行"
    assert one(tx.unique_lines, "a\nb\na\n\n\nb") == "a\nb\n\n"
    assert one(tx.collapse_marks, "好。。。吗？？") == "好。吗？"
    assert one(tx.clean_title, "第一部：书名 - 某网站") == "书名"
    assert one(tx.clean_title, "- 只有") is not None
    assert one(tx.chapter_number, "第 12 章 开始") == 12 and one(tx.chapter_number, "序") is None
    assert one(tx.base64_text, "aGVsbG8=") == "hello" and one(tx.base64_text, "no base") is None
    assert one(lambda c: tx.xor_text(c, 1), "6960") == "ha"
    assert one(tx.next_page, "http://a/b.html") == "http://a/b_2.html" and one(tx.next_page, "http://a/b_2.html") == "http://a/b_3.html" and one(tx.next_page, "http://a/b") is None
    assert one(lambda c: tx.absolute(F.lit("https://h.example/a/b?q"), c), "c") == "https://h.example/a/c"
    assert one(lambda c: tx.absolute(F.lit("https://h.example"), c), "//o/x") == "https://o/x"
    assert one(lambda c: tx.safe_cast(c, "int", 7), "x") == 7
    assert one(tx.longest_block, "<div>a</div><div><p>longer text</p></div>") == "longer text"
    assert one(tx.html_text, "<p>a&amp;b</p><script>x</script><br>c") == "a&b\nc"


def test_sites_and_charsets(spark):
    from quillspark.functions.charset import decode_bytes
    from quillspark.functions.sites import Registry

    known = Registry()
    known.stage("title")(lambda g: F.upper(g["t"]))
    known.stage("title", "a.com")(lambda g: F.when(g["t"] != "x", F.concat(F.lit("A "), g["t"])))
    known.alias["name"] = "title"
    df = spark.createDataFrame([("m.a.com", "q"), ("a.com", "x"), ("b.com", "q")], "host string, t string")
    got = df.select(known.column("name", F.col("host"), {"t": F.col("t")}).alias("c"), known.column("other", F.col("host"), {}).alias("o")).collect()
    assert [r.c for r in got] == ["A q", "X", "Q"] and all(r.o is None for r in got)
    texts = ["中文正文内容", "plain", "繁體中文內容"]
    raw = [(texts[0].encode("gb18030"),), (texts[1].encode(),), (texts[2].encode("utf-8"),), (b"\xff\xff\xff",), (None,)]
    out = [r.d for r in spark.createDataFrame(raw, "b binary").select(decode_bytes(F.col("b")).alias("d")).collect()]
    assert [o.text for o in out[:3]] == texts and [o.charset for o in out[:3]] == ["gb18030", "utf-8", "utf-8"]
    assert out[3].text == "\ufffd" * 3 and out[4].text is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert books.duplicate_pairs(empty).count() == 0
    assert quality.with_report(empty).count() == 0
    log = spark.createDataFrame([], "event_id long, url string, domain string, ts timestamp, hash long, result string")
    assert history.changes(log).count() == history.failure_runs(log).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.book").write_text('cb({"content": "x4e2dx6587", "replace": {}})', encoding="utf-8")
    (tmp_path / "ledger.tsv").write_text("# note\nhttps://a/1\ts\tb\nftp://a\ts\tb\nhttps://a/1\ts2\tb2\n", encoding="utf-8")
    (tmp_path / "map.csv").write_text("5,4e2d\nbad line\n40,4e2d\n", encoding="utf-8")
    (tmp_path / "log.txt").write_text("[QC] passed 3\nplain\n", encoding="utf-8")
    assert [r.decoded for r in tables.payload_files(spark, str(tmp_path / "a.book")).collect()] == ["中文"]
    assert tables.ledger(spark, str(tmp_path / "ledger.tsv")).count() == 1
    assert [(r.ctrl, r.hex) for r in tables.replacement_csv(spark, str(tmp_path / "map.csv")).collect()] == [(5, "4e2d")]
    assert [tuple(r) for r in tables.log_lines(spark, str(tmp_path / "log.txt")).collect()] == [("QC", "passed 3"), ("", "plain")]
    tables.write_replacement_csv(tables.replacement_csv(spark, str(tmp_path / "map.csv")), str(tmp_path / "out"))
    assert tables.replacement_csv(spark, str(tmp_path / "out")).count() == 1
