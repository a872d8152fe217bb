"""Pages as runs of tags and texts, in time linear in the page, broken pages included.

A tag ends before the next `<`; a script, style or comment without its closing mark is no such thing.
Patterns that run to a closing mark are tried only before the last one, so that an opening without
one costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Patterns in RE2's notation; `java` makes their bodies possessive.
SCRIPTS = "(?is)<(?:script|style)\\b[^<>]*>.*?</(?:script|style)>"
COMMENTS = "(?s)<!--.*?-->"
BLOCKS = "(?is)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title)\\b[^<>]*>"
TAG = "<[^<>]*>"
TOKEN = "<[^<>]*>|[^<]+|<"
TITLE = "(?is)<title\\b[^<>]*>(.*?)</title>"
ANCHOR = "(?is)<a\\b[^<>]*?href=\"([^\"<>]*)\"[^<>]*>.*?</a>"
ANCHOR_TEXT = "(?is)<a\\b[^<>]*?href=\"[^\"<>]*\"[^<>]*>(.*?)</a>"
NAME = "^</?([a-zA-Z][a-zA-Z0-9]*)"
#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def java(pattern: str) -> str:
    return pattern.replace("[^<>]*>", "[^<>]*+>").replace("[^<]+", "[^<]++")


def before_last(text: Column, mark: str) -> Column:
    """The text up to the last match of `mark`, with it; empty if there is none."""
    return F.regexp_extract(text, f"(?is)^.*{mark}", 0)


def dropped(text: Column, pattern: str, mark: str) -> Column:
    """Without the matches of `pattern`, each of which ends with `mark`."""
    head = before_last(text, mark)
    return F.concat(F.regexp_replace(head, java(pattern), ""), F.substr(text, F.length(head) + 1))


def bare(html: Column) -> Column:
    """Without scripts, styles and comments."""
    return dropped(dropped(html, SCRIPTS, "</(?:script|style)>"), COMMENTS, "-->")


def tokens(html: Column) -> Column:
    """All tags and the texts between them, in order; scripts, styles and comments go."""
    return F.regexp_extract_all(bare(html), F.lit(java(TOKEN)), 0)


def tag_name(token: Column) -> Column:
    """In lower case; empty for a text."""
    return F.lower(F.regexp_extract(token, NAME, 1))


def opens(token: Column) -> Column:
    """1 for a start tag that has an end tag, -1 for an end tag, else 0."""
    inside = token.rlike("^<[a-zA-Z]") & ~token.rlike("/>$") & ~tag_name(token).isin(*VOID)
    return F.when(token.rlike("^</[a-zA-Z]"), -1).when(inside, 1).otherwise(0)


def attribute(token: Column, name: str) -> Column:
    """The quoted value of an attribute; empty without it."""
    return F.regexp_extract(token, f"(?i)\\s{name}=[\"']([^\"'<>]*)[\"']", 1)


def is_element(token: Column, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Whether a token begins an element `tag`, of which the attribute (for class: one of its words) is `value`."""
    hit = (tag_name(token) == tag) & token.rlike("^<[a-zA-Z]")
    if attr == "class":
        return hit & F.array_contains(F.split(attribute(token, attr), "\\s+"), value)
    return hit & (attribute(token, attr) == value) if attr else hit


def inner(parts: Column, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Of `tokens`, those inside the first such element, up to the end tag that closes it, elements of its kind within it counted;
    all that follow if nothing closes it, null if there is none."""
    marked = F.transform(parts, lambda t, i: F.when(is_element(t, tag, attr, value), i))
    first = F.array_min(marked)  # nulls are passed over
    rest = F.slice(parts, first + 2, F.greatest(F.size(parts) - first - 1, F.lit(0)))
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("taken"))

    def step(held, t):
        open_ = held["open"] + F.when(tag_name(t) == tag, opens(t)).otherwise(0)
        return F.when(held["open"] <= 0, held).otherwise(F.struct(open_.alias("open"), F.when(open_ > 0, held["taken"] + 1).otherwise(held["taken"]).alias("taken")))

    return F.when(first.isNotNull(), F.slice(rest, 1, F.aggregate(rest, start, step)["taken"]))
