"""Predicates and classes of landed pages: blocks by mechanism, soft blocks, failures, links and catalogs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from ..sources.config import legal
from . import markup

#: Mechanism, strong marker, weak word, confidence, advice; the first that holds decides. A weak word needs a real input box or image.
MECHANISMS = (
    ("edge_challenge", "cf-chl-|challenge-platform", "checking your browser", 0.95, "wait"),
    ("captcha", "g-recaptcha|h-captcha", "captcha", 0.9, "manual"),
    ("script_challenge", "document\\.cookie\\s*=.*location\\.reload", "enable javascript", 0.85, "browser"),
    ("firewall", "web application firewall|waf-block", "firewall", 0.85, "slow down"),
    ("rate_limit", "too many requests", "slow down", 0.8, "back off"),
    ("address_block", "your ip (?:address )?has been blocked", "access denied", 0.8, "change address"),
    ("verify_page", "verify you are human", "verification", 0.75, "manual"),
)
CORROBORATES = "(?i)<(?:input|img)\\b"
SOFT_BLOCK = "(?i)(?:please )?try again later"
DNS_FAILURE = "(?i)name or service not known|nxdomain|getaddrinfo failed|could not resolve"
#: Page names that are never chapters.
NOT_CHAPTERS = ("liked", "index", "indexlist", "bookcase", "comment", "about", "ch1", "dx1")
NAVIGATION = "^(?:home|next|previous|top|login|sign in)$"


def mechanisms(html: Column) -> Column:
    """All mechanisms that hold, as array of (mechanism, confidence, evidence, advice) by priority."""
    real = html.rlike(CORROBORATES)

    def one(name, strong, weak, confidence, advice):
        within = markup.before_last(html, strong.split(".*")[-1]) if ".*" in strong else html  # so no start runs to the page's end in vain
        s, w = F.regexp_extract(within, f"(?is){strong}", 0), F.regexp_extract(html, f"(?i){weak}", 0)
        hit = F.when(s != "", F.struct(F.lit(name).alias("mechanism"), F.lit(confidence).alias("confidence"), F.lower(s).alias("evidence"), F.lit(advice).alias("advice")))
        return hit.when((w != "") & real, F.struct(F.lit(name).alias("mechanism"), F.lit(round(confidence - 0.3, 2)).alias("confidence"), F.lower(w).alias("evidence"), F.lit(advice).alias("advice")))

    return F.array_compact(F.array(*[one(*m) for m in MECHANISMS]))


def bare_challenge(status: Column, html: Column) -> Column:
    """401 or 403, a body under 4 kB, and no known marker."""
    return status.isin(401, 403) & (F.octet_length(html) < 4096) & (F.size(mechanisms(html)) == 0)


def unless_soft_block(html: Column, content: Column) -> Column:
    return F.when(~html.rlike(SOFT_BLOCK), content)


def domain_dead(status: Column, error: Column) -> Column:
    """Unreachable, and the error names a failed lookup; a passing 502 is none."""
    return status.isNull() & F.coalesce(error.rlike(DNS_FAILURE), F.lit(False))


def failure_phrase(status: Column, chapters: Column) -> Column:
    return F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).when(status.isNull(), "timeout").when(chapters == 0, "empty").otherwise("ok")


def page_name(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "/([^/?#]+?)(?:\\.html?)?(?:[?#].*)?$", 1))


def chapter_link(url: Column, title: Column, shape: str | None = None, path: Column | None = None) -> Column:
    """Neither a page name nor a title of the black lists, of the configured shape (an illegal one passes all), below the book's path (an empty one passes all)."""
    good = ~page_name(url).isin(*NOT_CHAPTERS) & ~F.lower(title).rlike(NAVIGATION)
    if shape and legal(SparkSession.active(), [shape]):
        good = good & url.rlike(shape)
    return good if path is None else good & ((F.coalesce(path, F.lit("")) == "") | url.contains(path))


def score_class(x: Column) -> Column:
    return F.when(x >= 0.85, "good").when(x >= 0.7, "fair").otherwise("poor")


def catalog_of(url: Column) -> Column:
    """The catalog of a chapter's URL: the folder; a URL without one stays."""
    return F.coalesce(F.nullif(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/(?:[^?#]*/)?)[^/?#]+", 1), F.lit("")), url)


#: Ordered patterns of a book's path; numbered pages, indexes, and last segments without an extension stand before the first folder of any kind.
BOOK_PATHS = (
    "(/(?:book|novel|txt)/[0-9]+/?)", "(/[0-9]+/[0-9]+/)", "(/[0-9]+_[0-9]+/)", "(/[a-z]{2}/[0-9]+)", "(/[A-Za-z0-9]{2,12}/)index(?:list)?(?:_[0-9]+)?[.]html?$",
    "(/[A-Za-z0-9]+/)[0-9]+[.]html?$", "(/[^/.]+)$", "(/[^/]+/)",
)


def book_path(path: Column) -> Column:
    """By the first pattern that holds; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(path, f"^{p}", 1), F.lit("")) for p in BOOK_PATHS])


def page_cap(site: Column, usual: int = 20, most: int = 30) -> Column:
    return F.least(F.coalesce(site, F.lit(usual)), F.lit(most))


#: Functions whose large Base64 arguments are known.
KNOWN_DECODERS = ("atob", "decode", "d")


def unknown_decoders(body: Column, least: int = 40) -> Column:
    """Names of functions outside the known ones that get a large Base64 argument."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(body, F.lit(f"([A-Za-z_$][\\w$]*+)\\(['\"][A-Za-z0-9+/=]{{{least},}}['\"]\\)"), 1)), F.array(*map(F.lit, KNOWN_DECODERS)))


def tidy_data_file(text: Column, statistics: str = "^(?:chars|lines|sha256)\\s*[:=]") -> Column:
    """Without the first line, which holds meta data, and without lines of statistics."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: (i > 0) & ~x.rlike(statistics)), "\n")


def fallback_title(title: Column, host: Column, path: Column) -> Column:
    """A title that says nothing gives way to host and first path segment."""
    said = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return F.when(said.isin("", "index", "untitled", "home", "novel", "book"), F.concat_ws(" ", host, F.nullif(F.regexp_extract(path, "^/([^/]+)", 1), F.lit("")))).otherwise(title)


def char_map(text: Column, given: str, meant: str) -> Column:
    return F.translate(text, given, meant)
