"""Queries over repaired texts, packed scripts, names, site rules and probes, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import chars, repair as rp, text as tx
from ..operators import history as h
from ..sources import config
from ..sources.tables import RISK_EVENT, shared_folder, table
from .log_queries import CRAWL_LOG, crawl_log, run_stream
from .views import CJK_DOCUMENTS, cjk_documents
from .web_queries import _HOST, _TITLE

LAYOUT = rp.LayoutRules(marks=".!?", closers="\"”’)", openers="“", glue=" ", least=400, most=1200)
PINYIN = " Zhongguo nǐhǎo women BEIJING lǜ xian"
ACE = (("xn--vcsx64d.", None), ("xn--bcher-kva.", None), ("plain.", "plain."), ("xn--mgbh0fb.", None), ("xn--.", "xn--."))


def resegmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat texts in paragraphs, with a digest, and how many paragraphs they have."""
    docs = table(spark, sf_dir, "documents").withColumn("t", rp.resegmented(F.col("text"), LAYOUT))
    return docs.select("doc_id", F.sha2("t", 256).alias("sha256"), F.size(F.split("t", "\n\n", -1)).cast("long").alias("parts"))


def syllable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", rp.without_syllable_runs(F.concat("text", F.lit(PINYIN))).alias("t"))
    return docs.select("doc_id", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("chars"))


def packed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts packed as scripts in base 62, and opened again."""
    digits = F.lit(rp._DIGITS)
    digit = lambda n: F.substr(digits, (n % 62 + 1).cast("int"), F.lit(1))
    coded = lambda n: F.concat(*[F.when(n >= 62**k, digit(F.floor(n / 62**k))).otherwise("") for k in (5, 4, 3, 2, 1)], digit(n))
    parts = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_]++|[^A-Za-z0-9_]++"), 0)
    is_word = lambda w: w.rlike("^[A-Za-z0-9]")
    # every other part is a word: its number is its place among them, so none is looked up
    docs = table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    first = F.when(F.get("parts", F.lit(0)).rlike("^[A-Za-z0-9_]"), 0).otherwise(1)
    docs = docs.withColumn("words", F.transform(F.filter("parts", lambda w, i: i % 2 == first), lambda w: F.when(is_word(w), w).otherwise("")))
    payload = F.array_join(F.transform("parts", lambda w, i: F.when(is_word(w), coded(F.floor(i / 2))).otherwise(w)), "")
    escaped = F.regexp_replace(payload, r"(['\\])", r"\\$1")
    body = F.concat(F.lit("eval(function(p,a,c,k,e,d){return p}('"), escaped, F.lit("',62,"), F.size("words").cast("string"), F.lit(",'"), F.array_join("words", "|"), F.lit("'.split('|'),0,{}))"))
    return docs.select("doc_id", body.alias("body")).select("doc_id", F.sha2(rp.unpacked(F.col("body")), 256).alias("sha256"))


def punycode_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with an ACE label in front, decoded."""
    ace = F.element_at(F.array(*[F.lit(a) for a, _ in ACE]), (F.col("page_id") % len(ACE) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", rp.unicode_host(F.concat(ace, tx.host(F.col("url")))).alias("host"))


def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the pages' domains, written as JSON files in three folders and read again."""
    root = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "pages").select(tx.host(F.col("url")).alias("domain"), "page_id").groupBy("domain").agg(F.min("page_id").alias("id"))
    site, local, built = p.where("id % 3 = 0"), p.where("id % 2 = 0"), p
    rules = F.struct(F.array(F.lit("was"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("keywords"), F.array(F.lit("^Th.*[.]$"), F.lit("([")).alias("line_regex"))
    given = {
        "site": site.select("domain", (F.col("id") % 2 == 0).alias("enabled"), F.lit("site").alias("ua")),
        "local": local.select("domain", (F.col("id") % 7).alias("tier_cap"), F.lit("local").alias("ua")),
        "built-in": built.select(F.upper("domain").alias("domain"), F.lit(9).alias("tier_cap"), F.when(F.col("id") % 5 == 0, rules).alias("ad_rules")),
    }
    for name, df in given.items():  # a file is an array of rules, one per domain
        df.agg(F.to_json(F.collect_list(F.struct(*df.columns)))).write.text(f"{root}/{name}")
    return config.site_rules(spark, [f"{root}/{k}" for k in ("site", "local", "built-in")])


def site_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of each domain, field by field from the first source that has one."""
    return _configured(spark, sf_dir).select("domain", "enabled", "tier_cap", "ua", F.coalesce(F.size("ad_rules.keywords"), F.lit(0)).alias("words"))


def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the rules of its host that are enabled; the configured cap stands before the usual one."""
    p = table(spark, sf_dir, "pages").withColumn("host", tx.host(F.col("url")))
    rules = _configured(spark, sf_dir).where("enabled").select(F.col("domain").alias("suffix"), "tier_cap", "ua")
    found = h.suffix_join(p, rules, tx.host_suffixes(F.col("host")), "page_id")
    return found.select("page_id", F.coalesce("rule.tier_cap", F.lit(3)).alias("tier_cap"), F.coalesce("rule.ua", F.lit("usual")).alias("ua"))


def site_ad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages without advertising lines, by built-in rules and by those of their site; an illegal pattern is skipped."""
    p = table(spark, sf_dir, "pages")
    t = config.without_ads(tx.html_text(F.col("html")), tx.host(F.col("url")), _configured(spark, sf_dir), ["that"], ["^A.*[.]$", "*("])
    return p.select("page_id", F.sha2(t, 256).alias("sha256"))


def ledger_search(spark: SparkSession, sf_dir: str, word: str = "the") -> DataFrame:
    """Pages that a search for a word finds: by their title in a ledger, by their URL where it has none."""
    p = table(spark, sf_dir, "pages")
    names = p.where("page_id % 2 = 0").select("page_id", F.lower(tx.html_title(F.col("html"))).alias("title"))
    return p.join(names, "page_id", "left").where(F.coalesce(F.col("title").contains(word), F.col("url").contains(word))).select("page_id")


def book_totals_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, ideographs and bytes of all texts of a source."""
    letters = F.length(F.regexp_replace("text", chars.java(chars.CJK, negate=True), ""))
    return cjk_documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("books"), F.sum(F.length("text")).alias("chars"), F.sum(letters).alias("cjk"), F.sum(F.octet_length("text")).alias("bytes"))


def site_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last probe of each domain: status, latency, engine, and the mechanism that a failure suggests."""
    log = crawl_log(spark, sf_dir)
    record = F.struct(F.col("result").alias("status"), F.col("hash").alias("latency"), F.col("event_type").alias("engine"), F.when(F.col("result") == "failed", F.when(F.col("hash") % 2 == 0, "rate_limit").otherwise("captcha")).alias("mechanism"))
    return log.groupBy("domain").agg(F.max_by(record, F.struct("ts", "event_id")).alias("p")).select("domain", "p.*")


def stream_risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk events that three origins append as JSON lines, counted as they come."""
    log = crawl_log(spark, sf_dir).where("result = 'failed'")
    path = f"{shared_folder(spark)}/risk-{uuid.uuid4().hex}"
    for k, origin in enumerate(("crawler", "probe", "check")):
        part = log.where(f"event_id % 3 = {k}").select(F.lit(origin).alias("origin"), "domain", F.col("ts").cast("timestamp").alias("ts"), F.lit("failure").alias("kind"), F.col("url").alias("detail"))
        part.write.mode("append").json(path)
    events = spark.readStream.schema(RISK_EVENT).option("maxFilesPerTrigger", 16).json(path)
    return run_stream(spark, events.groupBy("origin", "domain", "kind").agg(F.count("*").alias("n")), "complete")


QUERIES = {f.__name__: f for f in (resegmented, syllable_runs, packed_bodies, punycode_hosts, site_config, page_rules, site_ad_lines, ledger_search, book_totals_cjk, site_probes, stream_risk_events)}

_SYL = "|".join(rp.all_syllables())
_PLAIN = f"replace(translate(lower(w), '{rp.TONED}', '{rp.UNTONED}'), 'v', 'ü')"
_RUN = f"CASE WHEN translate(lower(w), '{rp.TONED}', '{rp.UNTONED}') <> lower(w) THEN regexp_full_match({_PLAIN}, '(?:{_SYL})+') ELSE lower(w) NOT IN ({', '.join(repr(w) for w in rp.ENGLISH)}) AND regexp_full_match({_PLAIN}, '(?:{_SYL})+') AND NOT regexp_full_match({_PLAIN}, '{_SYL}') END"
_NOT_WORD = f"[^A-Za-zÀ-ÖØ-öø-ɏ{rp.TONED}]+"
_M, _C = LAYOUT.marks, LAYOUT.closers
_TRIMMED = lambda x: f"regexp_replace({x}, '{chars.TRIM}', '', 'g')"
_LINE_LIST = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIMMED('x')}), lambda x: x <> '')"
_RULES_SQL = f"""(SELECT domain, CASE WHEN id % 3 = 0 THEN id % 2 = 0 ELSE TRUE END AS enabled, CASE WHEN id % 2 = 0 THEN id % 7 ELSE 9 END::INT AS tier_cap, CASE WHEN id % 3 = 0 THEN 'site' WHEN id % 2 = 0 THEN 'local' END AS ua, id
 FROM (SELECT {_HOST} AS domain, min(page_id) AS id FROM pages GROUP BY 1))"""
_SHOWN = ", ".join(f"({k}, '{(a[:-1].encode().removeprefix(b'xn--').decode('punycode') + '.') if u is None else u}')" for k, (a, u) in enumerate(ACE))


def _text_sql() -> str:
    from .web_queries import _HTML

    return _HTML


SQL = {
    "resegmented": f"""WITH RECURSIVE l AS (SELECT doc_id, text, {_LINE_LIST} AS ls FROM documents), z AS (SELECT *, list_sort(list_transform(ls, lambda x: length(x))) AS sizes, len(list_filter(ls, lambda x: NOT regexp_matches(x, '[{_M}][{_C}]*$'))) AS bare FROM l),
f AS (SELECT doc_id, text, ls, coalesce(len(ls) > 0 AND (sizes[(len(ls) - 1) // 2 + 1] > {LAYOUT.median} OR (len(ls) = 1 AND sizes[1] > {LAYOUT.single}) OR (len(ls) > 1 AND bare >= len(ls) * 0.9::DOUBLE)), FALSE) AS flat FROM z),
a AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(array_to_string(ls, ' '), '[^{_M}]*[{_M}]+[{_C}]*|[^{_M}]+'), lambda x: {_TRIMMED("x")}), lambda x: x <> '') AS ss FROM f WHERE flat),
s AS (SELECT doc_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM a),
r AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS size, 0::BIGINT AS op, 0::BIGINT AS st, FALSE AS ended, FALSE AS brk, '' AS x FROM s
 UNION ALL SELECT doc_id, i, CASE WHEN brk THEN 0 ELSE size END + length(x), greatest(op + (length(x) - length(replace(x, '“', ''))) - (length(x) - length(translate(x, '”’)', ''))), 0), (st + length(x) - length(replace(x, '"', ''))) % 2, regexp_matches(x, '[{_M}][{_C}]*$'), brk, x
 FROM (SELECT s.doc_id, s.i, s.x, r.size, r.op, r.st, r.size > 0 AND r.op = 0 AND r.st = 0 AND (r.size >= {LAYOUT.most} OR (r.size >= {LAYOUT.least} AND r.ended) OR regexp_matches(s.x, '^[“"]')) AS brk FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)),
g AS (SELECT doc_id, string_agg(CASE WHEN i = 1 THEN '' WHEN brk THEN chr(10) || chr(10) ELSE ' ' END || x, '' ORDER BY i) AS t FROM r WHERE i > 0 GROUP BY doc_id),
t AS (SELECT f.doc_id, CASE WHEN flat THEN g.t ELSE text END AS t FROM f LEFT JOIN g USING (doc_id)) SELECT doc_id, sha256(t) AS sha256, len(string_split(t, chr(10) || chr(10))) AS parts FROM t""",
    "syllable_runs": f"SELECT doc_id, sha256(t) AS sha256, length(t)::BIGINT AS chars FROM (SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text || '{PINYIN}', '{rp.WORD}|{_NOT_WORD}'), lambda w: NOT (regexp_full_match(w, '{rp.WORD}') AND {_RUN})), '') AS t FROM documents)",
    "packed_bodies": "SELECT doc_id, CASE WHEN length(text) >= 100 THEN sha256(text) END AS sha256 FROM documents",
    "punycode_hosts": f"SELECT page_id, v.shown || {_HOST} AS host FROM pages JOIN (VALUES {_SHOWN}) v(k, shown) ON v.k = page_id % {len(ACE)}",
    "site_config": f"SELECT domain, enabled, tier_cap, ua, CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END AS words FROM {_RULES_SQL}",
    "page_rules": f"SELECT page_id, coalesce(r.tier_cap, 3) AS tier_cap, coalesce(r.ua, 'usual') AS ua FROM pages LEFT JOIN {_RULES_SQL} r ON r.domain = {_HOST} AND r.enabled",
    "site_ad_lines": f"""SELECT page_id, sha256(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (contains(x, 'that') OR regexp_matches(x, '^A.*[.]$') OR (own AND (contains(x, 'was') OR contains(x, 'w' || id) OR regexp_matches(x, '^Th.*[.]$'))))), chr(10))) AS sha256
 FROM (SELECT page_id, {_text_sql()} AS t, r.enabled AND r.id % 5 = 0 AS own, r.id FROM pages JOIN {_RULES_SQL} r ON r.domain = {_HOST})""",
    "ledger_search": f"SELECT page_id FROM pages WHERE CASE WHEN page_id % 2 = 0 THEN contains(lower({_TITLE}), 'the') ELSE contains(url, 'the') END",
    "book_totals_cjk": f"SELECT source, count(*) AS books, sum(length(text))::BIGINT AS chars, sum(length(regexp_replace(text, '{chars.re2(chars.CJK, negate=True)}', '', 'g')))::BIGINT AS cjk, sum(strlen(text))::BIGINT AS bytes FROM {CJK_DOCUMENTS} GROUP BY source",
    "site_probes": f"SELECT domain, result AS status, hash AS latency, event_type AS engine, CASE WHEN result = 'failed' THEN CASE WHEN hash % 2 = 0 THEN 'rate_limit' ELSE 'captcha' END END AS mechanism FROM {CRAWL_LOG} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) = 1",
    "stream_risk_events": f"SELECT CASE event_id % 3 WHEN 0 THEN 'crawler' WHEN 1 THEN 'probe' ELSE 'check' END AS origin, domain, 'failure' AS kind, count(*) AS n FROM {CRAWL_LOG} WHERE result = 'failed' GROUP BY ALL",
}
