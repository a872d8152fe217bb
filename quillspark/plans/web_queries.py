"""Queries over landed pages, chapters and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import chars, markup, text as tx
from ..operators import books, history as h
from ..sources.tables import table
from .views import CHAPTERS, chapters

TRIM = chars.TRIM


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("t", tx.html_text(F.col("html"))).select("page_id", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("chars"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class per page by priority, from structure and size."""
    p = table(spark, sf_dir, "pages")
    body = F.col("html")
    kind = F.when(body.contains("captcha") & body.contains("challenge") & (F.length(body) < 16384), "challenge").when(F.lower(tx.html_title(body)).rlike("502 bad gateway|504 gateway time-?out|service unavailable"), "gateway").when(~body.rlike("(?i)<p\\b"), "no_paragraphs").when(F.length(body) < 4096, "short").otherwise("content")
    return p.select("page_id", kind.alias("kind"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.host(F.col("url")).alias("host"), tx.normal_url(F.col("url")).alias("url"), tx.next_page(F.concat(tx.normal_url(F.col("url")), F.lit(".html"))).alias("next"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links of each page in order, http and https only, first occurrences."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(tx.anchors(F.col("html"))).alias("ord", "a"))
    return p.select("page_id", F.col("ord").cast("long").alias("ord"), tx.absolute(F.col("url"), F.col("a.href")).alias("link")).where(F.col("link").rlike("^https?://"))


def repeated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.suspicious(page_links(spark, sf_dir).withColumnsRenamed({"page_id": "catalog", "link": "url"}), least=2)


def stable_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link texts of a page without repeats, in order of first occurrence."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_distinct(F.transform(tx.anchors(F.col("html")), lambda a: a["text"])), "|").alias("texts"))


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the rule of its host's longest known suffix; rules are counted from the pages themselves."""
    p = table(spark, sf_dir, "pages").withColumn("host", tx.host(F.col("url")))
    rules = p.select(F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("pages"))
    return h.suffix_join(p, rules, tx.host_suffixes(F.col("host")), "page_id").select("page_id", F.col("rule.suffix").alias("suffix"), F.col("rule.pages").alias("pages"))


def ledger_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ledgers of one key merged: the first filled value wins, sources are collected."""
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("u"), (F.col("doc_id") % 300).cast("string"))
    a = d.where("doc_id % 3 = 0").groupBy(key.alias("url")).agg(F.min("lang").alias("site"), F.lit("").alias("book"), F.lit("programs").alias("provenance"))
    b = d.where("doc_id % 2 = 0").groupBy(key.alias("url")).agg(F.lit(None).cast("string").alias("site"), F.min("source").alias("book"), F.lit("shelf").alias("provenance"))
    c = d.groupBy(key.alias("url")).agg(F.max("lang").alias("site"), F.max("source").alias("book"), F.lit("history").alias("provenance"))
    return h.merge_ledgers(a, b, c).select("url", "site", "book", F.array_join("provenance", ",").alias("provenance"))


def ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their site's name from a ledger; the host where it has none."""
    p = table(spark, sf_dir, "pages").withColumn("host", tx.host(F.col("url")))
    names = p.where("page_id % 4 = 0").groupBy("host").agg(F.concat(F.lit("site "), F.min("page_id").cast("string")).alias("name"))
    return p.join(names, "host", "left").select("page_id", F.coalesce("name", "host").alias("site"))


def same_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one normal title on different hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", tx.host(F.col("url")).alias("host"), tx.normal_title(tx.html_title(F.col("html"))).alias("title"))
    return p.groupBy("title").agg(F.count_distinct("host").alias("hosts"), F.count("*").alias("pages")).where("hosts > 1")


def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", tx.safe_cast(raw, "bigint", -1).alias("n"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def chapter_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.consistency(chapters(spark, sf_dir))


def chapter_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.drop_outliers(chapters(spark, sf_dir)).select("book", "no")


def chapter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters ranked by the number in their title; titles without one come last, in catalog order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "extra").otherwise(F.concat(F.lit("第"), (20 - F.col("turn")).cast("string"), F.lit("章"))).alias("title"))
    no = tx.chapter_number(F.col("title"))
    return c.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(no.asc_nulls_last(), "turn")).cast("long").alias("place"))


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chapters(spark, sf_dir)
    progress = c.where("book % 2 = 0").groupBy("book").agg(F.floor(F.avg("no")).cast("long").alias("done"))
    return books.remaining(c, progress).groupBy("book").agg(F.count("*").alias("left_over"))


def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as headed texts and read back: chapters per book, with a digest of the bodies."""
    from ..sources.tables import book_chapters, book_texts

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("ord"), F.concat(F.lit("chapter "), F.col("turn").cast("string")).alias("title"), F.replace("text", F.lit("\n## "), F.lit("\n# ")).alias("body"))
    back = book_chapters(book_texts(c), "text", "book").where("ord > 0")
    tidy = back.select("book", "ord", "title", F.regexp_replace(F.regexp_replace("body", "^\\n", ""), "\\n\\z", "").alias("body"))
    return tidy.groupBy("book").agg(F.count("*").alias("chapters"), F.sum(F.length("body")).alias("chars"))


def book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("books"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.min_by("doc_id", F.struct(-F.length("text"), "doc_id")).alias("largest"))


def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last five documents of each source."""
    w = Window.partitionBy("source")
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w.orderBy("doc_id")).alias("a"), F.row_number().over(w.orderBy(F.desc("doc_id"))).alias("b"))
    return d.where("a <= 5 or b <= 5").select("source", "doc_id")


def fewest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each host's URLs the one with the fewest path segments, then the least."""
    p = table(spark, sf_dir, "pages").select(tx.host(F.col("url")).alias("host"), tx.normal_url(F.col("url")).alias("url"))
    return p.groupBy("host").agg(F.min_by("url", F.struct(F.size(F.split("url", "/")), "url")).alias("url"))


def late_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'1998-06-01'")
    return table(spark, sf_dir, "orders").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def segments_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.cube("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b).groupBy("k").count().where("count > 60").select("k").withColumn("kind", F.lit("customers")))


QUERIES = {f.__name__: f for f in (
    html_texts, page_titles, page_classes, url_parts, page_links, repeated_links, stable_distinct, host_rules, ledger_union, ledger_lookup, same_title, safe_casts, chapter_gaps, chapter_outliers, chapter_order, resume, book_files,
    book_totals, head_and_tail, fewest_segments, late_shipments, segments_cube, key_sets,
)}

_ENT = lambda t: "".join(["replace(" for _ in tx.ENTITIES]) + t + "".join(f", '{a}', chr({ord(b)}))" for a, b in tx.ENTITIES)
_BARE = f"regexp_replace(regexp_replace(html, '{markup.SCRIPTS}', '', 'g'), '{markup.COMMENTS}', '', 'g')"
_T2 = f"regexp_replace(regexp_replace({_BARE}, '{markup.BLOCKS}', chr(10), 'g'), '{markup.TAG}', '', 'g')"
_HTML = f"array_to_string(list_filter(list_transform(string_split({_ENT(_T2)}, chr(10)), lambda x: regexp_replace(x, '{TRIM}', '', 'g')), lambda x: x <> ''), chr(10))"
_TITLE = f"regexp_replace(regexp_extract(html, '{markup.TITLE}', 1), '{TRIM}', '', 'g')"
_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1))"
_NORM = "(CASE WHEN TRUE THEN lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)', 1)) || regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') END)"
_LINKS = f"""SELECT page_id, ord, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN sch || ':' || href WHEN starts_with(href, '/') THEN sch || '://' || host || href ELSE folder || href END AS link FROM (
 SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS sch, {_HOST} AS host, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)', 1) AS folder, unnest(a) AS href, (generate_subscripts(a, 1) - 1)::BIGINT AS ord
 FROM (SELECT page_id, url, regexp_extract_all(html, '{markup.ANCHOR}', 1) AS a FROM pages))"""

SQL = {
    "html_texts": f"SELECT page_id, sha256(t) AS sha256, length(t)::BIGINT AS chars FROM (SELECT page_id, {_HTML} AS t FROM pages)",
    "page_titles": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_classes": f"SELECT page_id, CASE WHEN contains(html, 'captcha') AND contains(html, 'challenge') AND length(html) < 16384 THEN 'challenge' WHEN regexp_matches(lower({_TITLE}), '502 bad gateway|504 gateway time-?out|service unavailable') THEN 'gateway' WHEN NOT regexp_matches(html, '(?i)<p\\b') THEN 'no_paragraphs' WHEN length(html) < 4096 THEN 'short' ELSE 'content' END AS kind FROM pages",
    "url_parts": f"SELECT page_id, {_HOST} AS host, {_NORM} AS url, CASE WHEN regexp_matches({_NORM}, '_[0-9]{{1,6}}$') THEN NULL ELSE {_NORM} || '_2.html' END AS next FROM pages",
    "page_links": f"SELECT page_id, ord, link FROM ({_LINKS}) WHERE regexp_matches(link, '^https?://')",
    "repeated_links": f"SELECT page_id AS catalog, link AS url, count(*) AS times FROM ({_LINKS}) WHERE regexp_matches(link, '^https?://') GROUP BY ALL HAVING count(*) >= 2",
    "stable_distinct": f"SELECT page_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') AS texts FROM (SELECT page_id, list_transform(regexp_extract_all(html, '{markup.ANCHOR_TEXT}', 1), lambda t: regexp_replace(regexp_replace(t, '{markup.TAG}', '', 'g'), '{TRIM}', '', 'g')) AS a FROM pages)",
    "host_rules": f"SELECT page_id, suffix, count(*) OVER (PARTITION BY suffix) AS pages FROM (SELECT page_id, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS suffix FROM pages)",
    "ledger_union": """WITH d AS (SELECT *, 'u' || (doc_id % 300) AS url FROM documents), a AS (SELECT url, min(lang) AS site FROM d WHERE doc_id % 3 = 0 GROUP BY url), b AS (SELECT url, min(source) AS book FROM d WHERE doc_id % 2 = 0 GROUP BY url), c AS (SELECT url, max(lang) AS site, max(source) AS book FROM d GROUP BY url)
SELECT c.url, coalesce(a.site, c.site) AS site, coalesce(b.book, c.book) AS book, array_to_string(list_filter(['history', CASE WHEN a.url IS NOT NULL THEN 'programs' END, CASE WHEN b.url IS NOT NULL THEN 'shelf' END], lambda x: x IS NOT NULL), ',') AS provenance FROM c LEFT JOIN a USING (url) LEFT JOIN b USING (url)""",
    "ledger_lookup": f"WITH p AS (SELECT page_id, {_HOST} AS host FROM pages), n AS (SELECT host, 'site ' || min(page_id) AS name FROM p WHERE page_id % 4 = 0 GROUP BY host) SELECT page_id, coalesce(name, p.host) AS site FROM p LEFT JOIN n USING (host)",
    "same_title": f"SELECT title, count(DISTINCT host) AS hosts, count(*) AS pages FROM (SELECT {_HOST} AS host, regexp_replace(lower({_TITLE}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS title FROM pages) GROUP BY title HAVING count(DISTINCT host) > 1",
    "safe_casts": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "chapter_gaps": f"""WITH c AS (SELECT * FROM {CHAPTERS}), d AS (SELECT DISTINCT book, no FROM c), g AS (SELECT book, no + 1 AS low, lead(no) OVER (PARTITION BY book ORDER BY no) - 1 AS high FROM d),
m AS (SELECT book, string_agg(CASE WHEN high > low THEN low || '-' || high ELSE low::VARCHAR END, ',' ORDER BY low) AS missing, sum(high - low + 1)::BIGINT AS missing_numbers FROM g WHERE high >= low GROUP BY book)
SELECT c.book, count(*) AS chapters, coalesce(any_value(missing), '') AS missing, coalesce(any_value(missing_numbers), 0) AS missing_numbers, count(*) - count(DISTINCT no) AS repeated, min(no) > 1 AS starts_late FROM c LEFT JOIN m USING (book) GROUP BY c.book""",
    "chapter_outliers": f"WITH c AS (SELECT * FROM {CHAPTERS}), m AS (SELECT book, median(no) AS m FROM c GROUP BY book), k AS (SELECT c.book, c.no, c.no < 10 * m.m AS ok FROM c JOIN m USING (book)) SELECT book, no FROM (SELECT *, bool_or(ok) OVER (PARTITION BY book) AS has_ok FROM k) WHERE NOT has_ok OR ok",
    "chapter_order": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 4 = 3 THEN NULL ELSE 20 - turn END NULLS LAST, turn) AS place FROM conversations",
    "resume": f"WITH c AS (SELECT * FROM {CHAPTERS}), p AS (SELECT book, floor(avg(no))::BIGINT AS done FROM c WHERE book % 2 = 0 GROUP BY book) SELECT c.book, count(*) AS left_over FROM c LEFT JOIN p USING (book) WHERE done IS NULL OR no > done GROUP BY c.book",
    "book_files": "SELECT conv_id AS book, count(*) AS chapters, sum(length(replace(text, chr(10) || '## ', chr(10) || '# ')))::BIGINT AS chars FROM conversations GROUP BY conv_id",
    "book_totals": "SELECT source, count(*) AS books, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, first(doc_id ORDER BY length(text) DESC, doc_id) AS largest FROM documents GROUP BY source",
    "head_and_tail": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS b FROM documents) WHERE a <= 5 OR b <= 5",
    "fewest_segments": f"SELECT host, first(url ORDER BY len(string_split(url, '/')), url) AS url FROM (SELECT {_HOST} AS host, {_NORM} AS url FROM pages) GROUP BY host",
    "late_shipments": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1998-06-01') GROUP BY o_orderpriority",
    "segments_cube": "SELECT c_mktsegment, n_regionkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_regionkey)",
    "key_sets": "SELECT k, 'both' AS kind FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY k HAVING count(*) > 60",
}
