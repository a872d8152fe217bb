"""Page functions on broken and very long pages in linear time, and elements against a plain stack."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chars, markup, pages, text as tx
from quillspark.operators import tags


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


HARD = {
    "open tags": "<" * 1_000_000,
    "open comments": "<!--" * 250_000,
    "open scripts": "<script>" * 125_000,
    "script starts": "<script " * 125_000 + "</script>",
    "open links": '<a href="x">' * 80_000,
    "link starts": '<a href="' * 110_000,
    "attributes": "<a " + 'href="" ' * 120_000,
    "titles": "<title>" * 140_000,
    "one open tag": "<p" + " x" * 500_000,
    "blocks": "<div>" * 200_000,
}


@pytest.mark.parametrize("kind", HARD)
def test_a_broken_megabyte_takes_seconds(spark, kind):
    page = HARD[kind]
    began = time.time()
    for column in (tx.html_text, tx.html_title, tx.anchors, lambda c: F.size(markup.tokens(c)), lambda c: F.array_join(markup.inner(markup.tokens(c), "div"), ""), lambda c: F.size(pages.mechanisms(c))):
        one(spark, column, page)
    assert time.time() - began < 30


@pytest.mark.parametrize("line", ["a.a." * 250_000, "a@" * 500_000, "a@1.1." * 160_000, "www." * 250_000, "http" * 250_000])
def test_lines_of_addresses(spark, line):
    began = time.time()
    one(spark, lambda c: tx.drop_promo_lines(c, chars.LATIN), line)
    assert time.time() - began < 20


def test_addresses_are_found_as_before(spark):
    for given, want in (("write to a.b@c.de_x@y.com now", "write to  now"), ("see http://x.y/z end", "see  end"), ("a.a.a.a", "a.a.a.a"), ("x@y", "x@y"), ("..a@b.cd!", "!")):
        assert one(spark, lambda c: F.regexp_replace(c, tx.URL_LIKE_JAVA, ""), given) == want


def test_text_of_small_pages(spark):
    page = "<title> T &amp; t </title><script>var a='<p>';</script><p>one<br>two</p><!-- <p>no</p> --><a class='x' href=\"/u\">l<b>i</b>nk</a> a < b <unclosed"
    assert one(spark, tx.html_text, page) == "T & t\none\ntwo\nlink a < b <unclosed"
    assert one(spark, tx.html_title, page) == "T &amp; t"
    assert [tuple(x) for x in one(spark, tx.anchors, page)] == [("/u", "link")]
    for column in (tx.html_text, tx.html_title, tx.anchors):
        assert not one(spark, column, "") and one(spark, column, None) is None


def test_inner_counts_nested_elements(spark):
    page = '<div>x</div><div id="content">a<div>b</div><DIV>c<div>d</div></DIV>e</div>f'
    get = lambda *s: one(spark, lambda c: F.array_join(markup.inner(markup.tokens(c), *s), ""), page)
    assert get("div", "id", "content") == "a<div>b</div><DIV>c<div>d</div></DIV>e"
    assert get("div") == "x" and get("p") is None
    assert one(spark, lambda c: F.array_join(markup.inner(markup.tokens(c), "div", "class", "b"), ""), '<div class="a b">q<div>r') == "q<div>r"
    assert one(spark, lambda c: F.array_join(markup.inner(markup.tokens(c), "div"), ""), "<div>") == ""


class Plain(HTMLParser):
    """Elements of a page that closes what it opens: (start, end, name, depth, parent, letters)."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.found, self.at = [], [], -1

    def handle_starttag(self, tag, attrs):
        self.at += 1
        if tag in tags.CONTAINERS:
            self.open.append([self.at, None, tag, len(self.open) + 1, self.open[-1][0] if self.open else None, 0])

    def handle_endtag(self, tag):
        self.at += 1
        if tag in tags.CONTAINERS:
            e = self.open.pop()
            e[1] = self.at
            self.found.append(tuple(e))

    def handle_data(self, data):
        self.at += 1
        for e in self.open:
            e[5] += sum(c.isalpha() for c in data)


def tree(r, depth):
    if depth == 0 or r.random() < 0.3:
        return r.choice(["word ", "<p>ab</p>", "<b>x</b>1 ", "<br>"])
    tag = r.choice(["div", "section", "article", "td"])
    return f"<{tag}>" + "".join(tree(r, depth - 1) for _ in range(r.randrange(4))) + f"</{tag}>"


def test_elements_against_a_stack(spark):
    r = random.Random(5)
    given = [(k, "".join(tree(r, 6) for _ in range(4))) for k in range(40)] + [(98, None), (99, "")]
    df = spark.createDataFrame(given, "page_id long, html string")
    got = {}
    for e in tags.elements(tags.tag_events(df, script=chars.LATIN)).collect():
        got.setdefault(e.page, set()).add((e.start, e.end, e.name, e.depth, e.parent, e.letters))
    for k, page in given:
        plain = Plain()
        plain.feed(page or "")
        assert got.get(k, set()) == set(plain.found)


def test_best_block_and_its_wrapping(spark):
    rules = tags.BlockRules(script=chars.LATIN)
    text = "<p>" + "word " * 60 + "</p>"
    nav = "<nav>" + '<a href="x">menu item here</a>' * 20 + "</nav>"
    given = [(1, f"<body>{nav}<div><section>{text * 5}</section></div></body>"), (2, f"<body>{nav}</body>"), (3, f"<div>{text * 3}</div><div>{text * 5}</div>")]
    got = {r.page_id: r for r in tags.best_blocks(spark.createDataFrame(given, "page_id long, html string"), rules=rules).collect()}
    assert got[1].name == "section" and 2 not in got and got[3].score > 0.9
    assert got[3].block > 1


def test_selectors(spark):
    given = [(1, '<div id="content"></div><article>a<article>b</article>c</article>'), (2, "<p>none</p>"), (3, None)]
    df = spark.createDataFrame(given, "page_id long, html string").withColumn("selector", F.lit("clash"))
    got = {r.page_id: (r.selector, r.inner) for r in tags.first_selected(df, [("content", "div", "id", "content"), ("article", "article")]).collect()}
    assert got == {1: ("article", "a<article>b</article>c"), 2: (None, None), 3: (None, None)}
