"""Cleaning, HTML-to-text, decoding and URL functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import chars, markup
from .quality import once, trim

SPACES = "[ \\t\\r\\f\\x0b]+"
TERMINAL = "[。！？!?….”\"』」]$"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: In RE2's notation.
URL_LIKE = "(?i)(https?://[^\\s]+|www\\.[^\\s]+|[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,})"
#: The same for Java, in linear time: a mail address is tried where its first run of characters begins, or a match has ended.
URL_LIKE_JAVA = URL_LIKE.replace("|[a-z0-9._%+-]+@", "|(?:\\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++@")


# -- cleaning ---------------------------------------------------------------------------------


def drop_controls(text: Column) -> Column:
    """Without control, C1 and private-use characters; line feeds stay."""
    return F.regexp_replace(text, "[\\x{0}-\\x{9}\\x{b}-\\x{1f}\\x{7f}-\\x{9f}\\x{e000}-\\x{f8ff}]", "")


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def collapse_marks(text: Column) -> Column:
    """Repeated sentence marks become one."""
    for mark in "，。！？…!?":
        text = F.regexp_replace(text, f"[{mark}]{{2,}}", mark)
    return text


def rebuild_paragraphs(text: Column) -> Column:
    """Paragraphs, split at blank lines and trimmed, with exactly one blank line between."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n[ \\t]*\n+", -1), trim), lambda p: p != ""), "\n\n")


def indent_paragraphs(text: Column, indent: str = "\u3000\u3000") -> Column:
    """Each line that is no heading begins with the indent once; applying it again changes nothing."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when((trim(x) == "") | x.startswith("#"), x).otherwise(F.concat(F.lit(indent), trim(x)))), "\n")


def merge_short_lines(text: Column, least: int = 35) -> Column:
    """A line shorter than `least` that is no dialogue is appended to a line without a terminal mark. What a line is
    appended to ends as the line before it does, so each decision needs these two lines only."""
    lines = F.split(text, "\n", -1)
    before = lambda i: F.get(lines, i - 1)
    joins = lambda x, i: (F.length(x) < least) & (x != "") & ~x.rlike("^[“\"「『]") & (before(i) != "") & ~before(i).rlike(TERMINAL)
    return F.array_join(F.transform(lines, lambda x, i: F.when((i == 0) | joins(x, i), x).otherwise(F.concat(F.lit("\n"), x))), "")


def unique_lines(text: Column) -> Column:
    """Keeps the first of equal lines; blank lines are not counted as equal: their places make them different."""
    marked = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(trim(x) == "", F.concat(F.lit("\x00"), i.cast("string"), F.lit("\x00"), x)).otherwise(F.concat(F.lit("\x01"), x)))
    return F.array_join(F.transform(F.array_distinct(marked), lambda x: F.regexp_replace(x, "^(?:\\x01|\\x00[0-9]+\\x00)", "")), "\n")


def drop_ad_lines(text: Column, keywords: list[str], patterns: list[str] = ()) -> Column:
    """Without lines that contain a keyword or match a pattern; both lists only ever add to each other. Patterns must be legal
    (`sources.config.legal`)."""
    def is_ad(x):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | x.contains(k)
        for p in patterns:
            hit = hit | x.rlike(p)
        return hit

    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~is_ad(x)), "\n")


def drop_promo_lines(text: Column, script=chars.CJK, least: int = 10) -> Column:
    """A line with a URL or an email stays, without it, if `least` characters of the script remain; else it goes."""
    strip = lambda x: F.regexp_replace(x, URL_LIKE_JAVA, "")
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(URL_LIKE_JAVA) | (F.regexp_count(strip(x), F.lit(chars.java(script))) >= least))
    return F.array_join(F.transform(kept, lambda x: F.when(x.rlike(URL_LIKE_JAVA), strip(x)).otherwise(x)), "\n")


#: Wrong characters for right ones, where no right text holds the wrong form.
TYPOS = {"巳经": "已经", "按排": "安排", "复盖": "覆盖", "宏扬": "弘扬", "渡假": "度假", "歪曲事非": "歪曲是非"}


def replace_table(text: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements, in the order given."""
    for a, b in pairs.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean_title(title: Column) -> Column:
    """Without stacked part prefixes, bracketed tags, trailing site names, and a trailing number of long titles; never empty."""
    t = F.regexp_replace(title, "^(?:第[0-9一二三四五六七八九十百千]+[部卷][:：\\s]*)+", "")
    t = F.regexp_replace(t, "[\\[【（(](免费|vip|VIP|free)[\\]】）)]", "")
    t = trim(F.regexp_replace(t, "\\s*[-_|–—]\\s*[^-_|–—]*$", ""))
    t = F.when(F.length(t) >= 8, trim(F.regexp_replace(t, "[0-9]+$", ""))).otherwise(t)
    return F.coalesce(F.nullif(t, F.lit("")), title)


def normal_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^\\p{L}\\p{N}]+", "")


def chapter_number(title: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(title, "第\\s*([0-9]{1,9})\\s*章", 1), F.lit("")), F.lit("999999999")).cast("long")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[。！？!?…\\n.]+", -1), trim), lambda s: s != "")


def safe_cast(value: Column, kind: str, default) -> Column:
    """A dirty value gives the default, never an error."""
    return F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))


# -- HTML -------------------------------------------------------------------------------------


def html_text(html: Column) -> Column:
    """Scripts, styles and comments go, block tags end lines, other tags go, entities are decoded, blank lines go."""
    t = F.regexp_replace(markup.bare(html), markup.java(markup.BLOCKS), "\n")
    t = F.regexp_replace(t, markup.java(markup.TAG), "")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.transform(F.split(t, "\n", -1), trim), lambda x: x != ""), "\n")


def html_title(html: Column) -> Column:
    return trim(F.regexp_extract(markup.before_last(html, "</title>"), markup.java(markup.TITLE), 1))


def anchors(html: Column) -> Column:
    """array of (href, text) in page order."""
    closed = markup.java(markup.ANCHOR).replace("<a\\b", "<a\\b(?=[^<>]*+>)").replace("[^\"<>]*)", "[^\"<>]*+)")
    found = F.regexp_extract_all(markup.before_last(html, "</a>"), F.lit(closed), 0)
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, "(?i)href=\"([^\"<>]*+)\"", 1).alias("href"), trim(F.regexp_replace(a, markup.java(markup.TAG), "")).alias("text")))


def longest_block(html: Column) -> Column:
    """The text of the longest article, section or div without inner blocks of those kinds."""
    blocks = F.regexp_extract_all(html, F.lit("(?is)<(?:article|section|div)\\b[^<>]*+>(?:(?!<(?:article|section|div)\\b).)*?</(?:article|section|div)>"), 0)
    sized = F.transform(blocks, lambda b, i: F.struct(F.length(html_text(b)).alias("n"), (-i).alias("i"), html_text(b).alias("t")))
    return F.coalesce(F.array_max(sized)["t"], F.lit(""))


# -- body decoding ----------------------------------------------------------------------------

STANDARD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def base64_text(body: Column) -> Column:
    """Null if it is not Base64."""
    return F.when(body.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(body) % 4 == 0), F.try_to_binary(body, F.lit("base64")).cast("string"))


def base64_custom(body: Column, alphabet: str) -> Column:
    return base64_text(F.translate(body, alphabet, STANDARD))


def xor_text(body: Column, key: int) -> Column:
    """Bytes given as hex, each combined with the key by exclusive or."""
    pairs = F.transform(F.regexp_extract_all(body, F.lit(".."), 0), lambda b: F.conv(b, 16, 10).cast("int").bitwiseXOR(F.lit(key)))
    return F.when(body.rlike("^([0-9a-fA-F]{2})+$"), F.unhex(F.array_join(F.transform(pairs, lambda b: F.lpad(F.hex(b), 2, "0")), "")).cast("string"))


def joined_pieces(body: Column) -> Column:
    """The quoted pieces of a string concatenation, joined; null if it is none."""
    found = F.regexp_extract_all(body, F.lit("[\"']([^\"']*)[\"']"), 1)
    return F.when(body.rlike("^\\s*(?:[\"'][^\"']*[\"']\\s*\\+\\s*)*+[\"'][^\"']*[\"']\\s*;?\\s*$"), F.array_join(found, ""))


def script_calls(body: Column) -> Column:
    """Decoded Base64 arguments of `object.function('...')` calls, joined; null if there is none."""
    found = F.regexp_extract_all(body, F.lit("(?<![\\w$])[A-Za-z_$][\\w$]*+\\.[A-Za-z_$][\\w$]*+\\(['\"]([A-Za-z0-9+/=]{8,})['\"]\\)"), 1)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, base64_text), ""))


def decode_bodies(df: DataFrame, body: str) -> DataFrame:
    """`df` with `text` and `method`: what the first decoder that applies makes of column `body`."""
    c = F.col(body)
    df = once(df, {"__calls": script_calls(c), "__plain": base64_text(c), "__back": base64_text(F.reverse(c)), "__pieces": joined_pieces(c)})
    tried = {"calls": "__calls", "base64": "__plain", "reversed": "__back", "concat": "__pieces"}
    applies = lambda name: F.coalesce(F.col(name) != "", F.lit(False))
    text, method = c, F.lit("plain")
    for name, column in reversed(tried.items()):
        text, method = F.when(applies(column), F.col(column)).otherwise(text), F.when(applies(column), name).otherwise(method)
    return df.withColumn("method", method).withColumn("text", text).drop(*tried.values())


# -- URLs -------------------------------------------------------------------------------------


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def host_suffixes(h: Column) -> Column:
    """The host and its parents, longest first."""
    parts = F.split(h, "\\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def absolute(base: Column, href: Column) -> Column:
    """A link as seen from `base`: full, protocol-relative, rooted, or relative (also where the slash is missing)."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(F.length(folder) > F.length(scheme) + 3, folder).otherwise(F.concat(root, F.lit("/"))), href))


def normal_url(url: Column) -> Column:
    """Without query, fragment and trailing slash; scheme and host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)), F.regexp_replace(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""))


def next_page(url: Column) -> Column:
    """`..._2.html` after `....html`, `..._3.html` after that; null without the suffix."""
    n = F.regexp_extract(url, "_([0-9]{1,6})\\.html$", 1)
    return F.when(n != "", F.concat(F.regexp_replace(url, "_[0-9]+\\.html$", ""), F.lit("_"), (n.try_cast("int") + 1).cast("string"), F.lit(".html"))).when(url.endswith(".html"), F.concat(F.regexp_replace(url, "\\.html$", ""), F.lit("_2.html")))


def backoff(attempt: Column, retry_after: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """Seconds to wait: the server's wish, else base * 2 ** attempt, up to `most`."""
    return F.least(F.coalesce(retry_after.cast("double"), F.pow(F.lit(2.0), attempt) * base), F.lit(most))
