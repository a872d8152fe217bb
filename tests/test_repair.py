"""Repaired texts, packed scripts, names and site rules against plain Python, with null, empty and hard input."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import pages, repair as rp
from quillspark.sources import config


def each(spark, column, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    return [r.r for r in df.select("k", column(F.col("t")).alias("r")).orderBy("k").collect()]


RULES = rp.LayoutRules(marks="。！？!?…", least=20, most=60, median=50, single=50)


def laid_out(text, r=RULES):
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if not lines:
        return text
    sizes, bare = sorted(map(len, lines)), sum(not re.search(f"[{r.marks}][{r.closers}]*$", x) for x in lines)
    if not (sizes[(len(lines) - 1) // 2] > r.median or (len(lines) == 1 and sizes[0] > r.single) or (len(lines) > 1 and bare >= 0.9 * len(lines))):
        return text
    found = [x.strip() for x in re.findall(f"[^{r.marks}]*[{r.marks}]+[{r.closers}]*|[^{r.marks}]+", "".join(lines)) if x.strip()]
    out, size, open_, straight, ended = [], 0, 0, 0, False
    for x in found:
        if size and not open_ and not straight and (size >= r.most or (size >= r.least and ended) or x[0] in r.openers + '"'):
            out.append("\n\n")
            size = 0
        out.append(x)
        size += len(x)
        open_ = max(0, open_ + sum(c in r.openers for c in x) - sum(c in r.closers and c != '"' for c in x))
        straight = (straight + x.count('"')) % 2
        ended = bool(re.search(f"[{r.marks}][{r.closers}]*$", x))
    return "".join(out)


def test_paragraphs_and_idempotence(spark):
    r = random.Random(2)
    piece = lambda: "".join(r.choice("天地玄黄宇宙洪荒") for _ in range(r.randrange(1, 18)))
    made = ["".join(piece() + r.choice(["。", "！", "。”", "？", "……", "，", "\n", '"']) for _ in range(n)) for n in (1, 5, 20, 60, 60, 60)]
    quoted = ["“" + "好。" * 40 + "”" + "他走了。" * 20, "“没有合上。" * 30, '说："' + "是。" * 50 + '"完。', "。" * 300, "短。\n\n短。", "长" * 500]
    texts = [None, "", "\n \n", *made, *quoted, "一句。" * 8_000]
    once = each(spark, lambda c: rp.resegmented(c, RULES), texts)
    assert once == [t if t is None else laid_out(t) for t in texts]
    assert each(spark, lambda c: rp.resegmented(c, RULES), once) == once
    assert any("\n\n" in t for t in once[3:9])
    assert "\n\n" not in once[9].split("”")[0]  # no break inside the quotation


def test_syllables(spark):
    known = set(rp.all_syllables())
    assert 390 < len(known) < 420 and {"zhuang", "lüe", "er", "a"} <= known

    def least(word):
        plain = word.translate(str.maketrans(rp.TONED, rp.UNTONED)).replace("v", "ü")
        best = [0] + [None] * len(plain)
        for i in range(1, len(plain) + 1):
            found = [best[j] + 1 for j in range(max(0, i - 6), i) if best[j] is not None and plain[j:i] in known]
            best[i] = min(found) if found else None
        return best[-1] if plain else None

    r = random.Random(3)
    words = ["", "xian", "xīan", "zhongguo", "lvse", "the", "nǐ", "an" * 500, "an" * 500 + "x", "ng", "bb", "é"]
    words += ["".join(r.choice(sorted(known)) for _ in range(r.randrange(1, 5))) + r.choice(["", "", "n", "g", "h", "q"]) for _ in range(300)]
    assert each(spark, rp.syllables, words) == [least(w) for w in words]
    given = ["Zhongguo is nǐhǎo, women xian; XĪAN the zhuangbei banana hello lǚ", None, "", "no runs of it"]
    assert each(spark, rp.without_syllable_runs, given) == [" is , women xian;  the  banana hello ", None, "", "no runs of it"]


def packed(text, base):
    digits = rp._DIGITS
    words = list(dict.fromkeys(w for w in re.findall(r"\w+", text, re.A) if not w.startswith("_")))
    number = {w: "" for w in words}
    for k, w in enumerate(words):
        n, out = k, ""
        while True:
            out, n = digits[n % base] + out, n // base
            if not n:
                break
        number[w] = out
    body = re.sub(r"\w+", lambda m: number.get(m[0], m[0]), text, flags=re.A)
    keys = ["" if number[w] == w else w for w in words]
    return "eval(function(p,a,c,k,e,d){return p}('%s',%d,%d,'%s'.split('|'),0,{}))" % (body.replace("\\", "\\\\").replace("'", "\\'"), base, len(words), "|".join(keys))


@pytest.mark.parametrize("base", [2, 10, 36, 62])
def test_packed_scripts(spark, base):
    r = random.Random(base)
    texts = ["it's a \\ test_1 of é and 'more' _x " * 9] + [" ".join(r.choice(["alpha", "b2", "0", "10", "Z", "_", "x_y", "\n"]) + str(r.randrange(300)) for _ in range(200)) for _ in range(4)]
    assert each(spark, rp.unpacked, [packed(t, base) for t in texts]) == texts
    other = [None, "", "plain text", packed("too short", base), "}('" + "a" * 500_000, "}('0 1',99,2,'" + "a|b" * 50 + "'.split('|'),0,{})"]
    assert each(spark, rp.unpacked, other) == [None] * 6


def test_names(spark):
    names = ["bücher", "爱国", "мир", "αβγ", "ümlaut-ä", "日本語", "a" * 20 + "é", "😀x", "ñandú", "他们为什么不说中文"]
    ace = ["xn--" + n.encode("punycode").decode() for n in names]
    assert each(spark, rp.punycode, ace + [a.upper() for a in ace[1:4]]) == names + names[1:4]
    same = [None, "", "plain", "xn--", "xn--a-999999999999", "xn--é"]
    assert each(spark, rp.punycode, same) == same
    assert each(spark, rp.unicode_host, ["www.xn--bcher-kva.example", "a.b"]) == ["www.bücher.example", "a.b"]


def test_site_rules(spark, tmp_path):
    for name, rules in {
        "first": [{"domain": "A.example", "tier_cap": 1}, {"domain": "b.example", "enabled": False}, {"ua": "nobody"}],
        "second": {"domain": "a.example", "tier_cap": 5, "ua": "x", "other": 1, "ad_rules": {"keywords": ["buy"], "line_regex": ["([", "^ad"]}},
        "third": [{"domain": "b.example", "enabled": True, "ua": "y"}, {"domain": "c.example"}],
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "rules.json").write_text(json.dumps(rules, indent=1))
    (tmp_path / "third" / "broken.json").write_text("{not json")
    rules = config.site_rules(spark, [str(tmp_path / n) for n in ("first", "second", "third")])
    got = {r.domain: (r.enabled, r.tier_cap, r.ua) for r in rules.collect()}
    assert got == {"a.example": (True, 1, "x"), "b.example": (False, None, "y"), "c.example": (True, None, None)}
    df = spark.createDataFrame([("a.example", "buy\nad 1\nkeep\nspam"), ("www.a.example", "buy"), ("c.example", "buy\nad 1\nspam"), (None, "spam\nx"), ("a.example", None)], "d string, t string")
    out = [r.r for r in df.select(config.without_ads(F.col("t"), F.col("d"), rules, ["spam"], ["*("]).alias("r")).collect()]
    assert out == ["keep", "", "buy\nad 1", "x", None]


def test_illegal_shapes_pass_all(spark):
    df = spark.createDataFrame([("https://a/b1", "t")], "u string, t string")
    for shape, n in ((r"^https?://[^/]+/b\d", 1), ("^http$", 0), ("([", 1), (r"\k<x>", 1), (r"(?P<x>b)", 1)):  # the last is legal in Python only
        assert df.where(pages.chapter_link(F.col("u"), F.col("t"), shape)).count() == n
