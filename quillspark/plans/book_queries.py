"""Queries over duplicate books, their ledger, and titles, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import books, duplicates as du
from ..sources.tables import table
from .text_queries import ALIKE_SQL, ALIKE_VERDICTS_SQL, SQL as TEXT, alike_pairs, letters_of
from .web_queries import _HOST, _HTML, _TITLE


def duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its group and the number of its pairs."""
    pairs = alike_pairs(spark, sf_dir).select("a", "b")
    return du.classes(table(spark, sf_dir, "documents"), pairs).select("doc_id", F.col("group").alias("class_id"), "links")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan finds while every 17th text is still running; every third is approved."""
    docs = table(spark, sf_dir, "documents")
    ids, sizes = docs.select(F.col("doc_id").alias("id")), letters_of(docs)
    return du.actions(books.decide(books.duplicate_pairs(docs), sizes).select("a", "b", "verdict"), sizes, ids.where("id % 17 = 0"), ids.where("id % 3 = 0"))


def duplicate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).withColumnRenamed("group", "class_id")


def ledger_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after that scan: before it every document headed a group that was ignored, cleaned or open; every fifth was moved."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    state = F.when(F.col("doc_id") % 4 == 0, "ignored").when(F.col("doc_id") % 4 < 3, "cleaned").otherwise("open")
    old = d.select(F.col("doc_id").alias("group"), state.alias("status"))
    return du.merged_ledger(old, _scan(spark, sf_dir), d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"))).withColumnRenamed("group", "class_id")


def restored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that quarantined texts get back beside those present; nothing is overwritten."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("folder"))
    present = d.where("doc_id % 4 = 0").select("folder", F.concat(F.lit("book"), (F.col("doc_id") % 30).cast("string"), F.when(F.col("doc_id") % 8 == 0, " (restored 3).txt").otherwise(".txt")).alias("name"))
    name = F.when(F.col("doc_id") % 40 == 1, F.lit("../x")).otherwise(F.concat(F.lit("book"), (F.col("doc_id") % 30).cast("string"), F.lit(".txt")))
    back = du.restored_names(d.where("doc_id % 4 = 1").select("doc_id", "folder", name.alias("name")), present)
    return back.groupBy("folder", "name").agg(F.count("*").alias("files"), F.count_distinct("restored").alias("different"), F.min("restored").alias("least"))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as titled texts; every fourth title is a part of itself."""
    title = tx.html_title(F.col("html"))
    part = F.when(F.col("page_id") % 4 == 0, F.substring_index(title, " ", 3)).otherwise(title)
    return table(spark, sf_dir, "pages").select("page_id", tx.host(F.col("url")).alias("host"), part.alias("title"), tx.html_text(F.col("html")).alias("text"))


def same_title_other_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with others of the same title, or of one that holds it, whose texts have hardly a sentence in common."""
    return du.same_title_other_text(_titled(spark, sf_dir), "page_id", "title", "text")


def foreign_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of links that hold the title of another page of the same domain."""
    folder = F.regexp_extract(tx.host(F.col("url")), "([^.]+\\.[^.]+)$", 1)
    p = table(spark, sf_dir, "pages").select(folder.alias("folder"), F.col("page_id").alias("book"), tx.anchors(F.col("html")).alias("links"))
    own = p.select("folder", "book", F.get("links", F.lit(0))["text"].alias("title"))
    return du.foreign_titles(p.select("folder", "book", F.explode("links.text").alias("title")), own, least=3)


QUERIES = {f.__name__: f for f in (duplicate_classes, duplicate_actions, ledger_over_time, restored_files, same_title_other_text, foreign_titles)}

_REACH = "SELECT DISTINCT x AS id, x AS root FROM {e} UNION SELECT r.id, e.y FROM {r} r JOIN {e} e ON e.x = r.root"
_NORMAL = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_LETTERS = "length(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_SCAN = f"""WITH RECURSIVE z AS (SELECT doc_id AS id, {_LETTERS.format("text")} AS c FROM documents), v AS (SELECT * FROM ({ALIKE_VERDICTS_SQL}) WHERE verdict <> 'none' AND a % 17 <> 0 AND b % 17 <> 0),
e AS (SELECT a AS x, b AS y FROM v UNION ALL SELECT b, a FROM v), r AS ({_REACH.format(e="e", r="r")}),
m AS (SELECT r.id, min(root) AS grp, any_value(z.c) AS c FROM r JOIN z ON z.id = r.id GROUP BY r.id), best AS (SELECT grp, first(id ORDER BY c DESC, id) AS best FROM m GROUP BY grp),
l AS (SELECT DISTINCT CASE WHEN za.c > zb.c OR (za.c = zb.c AND a < b) THEN b ELSE a END AS id FROM v JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE verdict IN ('same', 'subset')),
s AS (SELECT m.grp, m.id, CASE WHEN m.id = best THEN 'keep' WHEN l.id IS NOT NULL OR m.id % 3 = 0 THEN 'move' ELSE 'review' END AS action FROM m JOIN best USING (grp) LEFT JOIN l ON l.id = m.id)"""
_SENT_OF = TEXT["sentence_counts"].split("SELECT doc_id, ")[2].split(" AS s FROM")[0]

SQL = {
    "duplicate_classes": f"""WITH RECURSIVE p AS ({ALIKE_SQL}), e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p), r AS ({_REACH.format(e="e", r="r")}),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM e GROUP BY x) SELECT doc_id, coalesce(root, doc_id) AS class_id, coalesce(n, 0) AS links FROM documents LEFT JOIN g ON g.id = doc_id LEFT JOIN n ON n.x = doc_id""",
    "duplicate_actions": f"{_SCAN} SELECT grp AS class_id, id, action FROM s",
    "ledger_over_time": f"""{_SCAN}, o AS (SELECT doc_id AS grp, CASE WHEN doc_id % 4 = 0 THEN 'ignored' WHEN doc_id % 4 < 3 THEN 'cleaned' ELSE 'open' END AS was FROM documents),
n AS (SELECT grp, count(*) FILTER (action = 'move' AND id % 5 <> 0) AS to_move, count(*) FILTER (action = 'review' AND id % 5 <> 0) AS to_review FROM s GROUP BY grp),
b AS (SELECT o.grp, was, n.grp IS NOT NULL AS seen, coalesce(to_move, 0) AS to_move, coalesce(to_review, 0) AS to_review FROM o LEFT JOIN n USING (grp))
SELECT grp AS class_id, CASE WHEN was = 'ignored' THEN was WHEN to_move + to_review > 0 THEN 'open' ELSE 'cleaned' END AS status, to_move, to_review FROM b WHERE was <> 'open' OR seen""",
    "restored_files": """WITH n AS (SELECT source AS folder, doc_id, 'book' || (doc_id % 30) AS stem FROM documents), u AS (SELECT folder, stem, max(CASE WHEN doc_id % 8 = 0 THEN 3 ELSE 0 END) AS most FROM n WHERE doc_id % 4 = 0 GROUP BY ALL),
q AS (SELECT folder, doc_id, CASE WHEN doc_id % 40 = 1 THEN '../x' ELSE stem || '.txt' END AS name, stem FROM n WHERE doc_id % 4 = 1),
p AS (SELECT q.*, row_number() OVER (PARTITION BY q.folder, q.name ORDER BY doc_id) AS k, most FROM q LEFT JOIN u USING (folder, stem)),
r AS (SELECT folder, name, CASE WHEN name = '../x' THEN NULL WHEN most IS NULL AND k = 1 THEN name ELSE stem || ' (restored ' || (CASE WHEN most IS NULL THEN k - 1 ELSE most + k END) || ').txt' END AS restored FROM p)
SELECT folder, name, count(*) AS files, count(DISTINCT restored) AS different, min(restored) AS least FROM r GROUP BY folder, name""",
    "same_title_other_text": f"""WITH h AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN array_to_string(string_split({_TITLE}, ' ')[1:3], ' ') ELSE {_TITLE} END AS t, {_HTML} AS text FROM pages),
d AS (SELECT page_id, {_NORMAL.format("t")} AS title, {_LETTERS.format("text")} AS c, list_distinct({_SENT_OF}) AS s FROM h), k AS (SELECT * FROM d WHERE title <> '' AND c >= 500)
SELECT a.page_id, count(*) AS partners FROM k a JOIN k b ON a.page_id <> b.page_id AND (contains(a.title, b.title) OR contains(b.title, a.title)) AND greatest(a.c, b.c) <= 3 * least(a.c, b.c)
WHERE len(list_intersect(a.s, b.s))::DOUBLE / greatest(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)), 1) < 0.05::DOUBLE GROUP BY a.page_id""",
    "foreign_titles": f"""WITH l AS (SELECT page_id AS book, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS folder, list_transform(regexp_extract_all(html, '(?is)<a\\b[^<>]*?href="[^"<>]*"[^<>]*>(.*?)</a>', 1), lambda x: trim(regexp_replace(x, '<[^<>]*>', '', 'g'))) AS links FROM pages),
o AS (SELECT folder, book, {_NORMAL.format("links[1]")} AS known FROM l), c AS (SELECT DISTINCT folder, book, title, {_NORMAL.format("title")} AS normal FROM (SELECT folder, book, unnest(links) AS title FROM l))
SELECT DISTINCT c.folder, c.book, c.title, o.known AS "foreign" FROM c JOIN o ON o.folder = c.folder AND length(o.known) >= 3 AND contains(c.normal, o.known) WHERE NOT EXISTS (SELECT 1 FROM o m WHERE m.folder = c.folder AND m.book = c.book AND m.known = o.known)""",
}
