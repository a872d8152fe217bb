"""Decoding of code-point streams: texts in which characters stand as hexadecimal code points.

Tokens are `x` and four hex digits, four hex digits, or one character, read greedily. Four bare
digits are a code point only right after a marker (U+0001..3 that the map does not replace). A
mapped control character gives its replacement; U+0004 a line feed; `;` and other control
characters nothing. Where one control character has several replacements, the greatest hex wins.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .quality import once

TOKEN = r"(?s)x[0-9a-fA-F]{4}|[0-9a-fA-F]{4}|."
WRAPPED = r"(?s)[a-zA-Z_]\w*\s*\(\s*(\{.*\})\s*\)\s*$"
DATA_FILE = r"\.(xs|book|data|txt|json)$"


def _char(hex_digits: Column, valid: Column) -> Column:
    """The character of up to 8 hex digits; anything where not valid (never evaluated on bad input)."""
    safe = F.when(valid, F.lpad(hex_digits, 8, "0")).otherwise(F.lit("00000041"))
    return F.decode(F.unhex(safe), "UTF-32")


def _scalar(hex_digits: Column) -> Column:
    """Whether the digits name a character: not a surrogate, not beyond U+10FFFF."""
    padded = F.lower(F.lpad(hex_digits, 6, "0"))
    return ~padded.between("00d800", "00dfff") & (padded <= "10ffff")


def replacement_map(replace: Column) -> Column:
    """From {hex: control character} to {control character: character}; other entries are left out."""
    good = F.filter(F.map_entries(replace), lambda e: e["key"].rlike("^[0-9a-fA-F]{2,6}$") & (F.length(e["value"]) == 1) & (e["value"] < " ") & _scalar(e["key"]))
    ranked = F.array_sort(F.transform(good, lambda e: F.struct(e["value"].alias("c"), F.lower(F.lpad(e["key"], 6, "0")).alias("h"), _char(e["key"], _scalar(e["key"])).alias("r"))))
    last = F.filter(ranked, lambda e: ~F.exists(ranked, lambda o: (o["c"] == e["c"]) & (o["h"] > e["h"])))
    one = F.array_distinct(F.transform(last, lambda e: F.struct(e["c"].alias("key"), e["r"].alias("value"))))
    return F.map_from_entries(F.coalesce(one, F.array().cast("array<struct<key:string,value:string>>")))


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TOKEN), 0)


def emit(toks: Column, mapping: Column) -> Column:
    """The text of a token array; both arguments should be plain columns, as the lambda reads them again and again."""
    marker = lambda t: t.isin("\x01", "\x02", "\x03") & F.element_at(mapping, t).isNull()

    def one(t, i):
        before = F.when(i > 0, marker(F.get(toks, i - 1))).otherwise(F.lit(False))
        h = F.right(t, F.lit(4))
        good = (F.length(t) >= 4) & _scalar(h)
        return (
            F.when(F.length(t) == 5, F.when(good, _char(h, good)).when(before, h).otherwise(t))
            .when(F.length(t) == 4, F.when(before & good, _char(h, good)).otherwise(t))
            .when(F.element_at(mapping, t).isNotNull(), F.element_at(mapping, t))
            .when(t == "\x04", "\n")
            .when((t == ";") | (t < " "), "")
            .otherwise(t)
        )

    return F.array_join(F.transform(toks, one), "")


#: Runs of tokens that are decoded in one step: `x` tokens, code points behind one marker, plain characters.
RUN = r"(?s)(?:x[0-9a-fA-F]{4})+|([\x01-\x03])[0-9a-fA-F]{4}(?:\1[0-9a-fA-F]{4})*|[^x;\x00-\x1f]+|."
#: A code point that is half of a surrogate pair names no character: such texts go token by token.
SURROGATE = r"[x\x01-\x03][dD][89a-fA-F][0-9a-fA-F]{2}"


def emit_runs(runs: Column, mapping: Column) -> Column:
    """The text of an array of runs, none of which has a surrogate."""
    chars = lambda r: F.decode(F.unhex(F.translate(r, "x\x01\x02\x03", "")), "UTF-16BE")

    def one(r):
        first = F.left(r, F.lit(1))
        mapped = F.element_at(mapping, first)
        return (
            F.when(first >= " ", F.when((first == "x") & (F.length(r) > 1), chars(r)).when(r == ";", "").otherwise(r))
            .when(mapped.isNotNull(), F.replace(r, first, mapped))
            .when(F.length(r) > 1, chars(r))
            .when(r == "\x04", "\n")
            .otherwise("")
        )

    return F.array_join(F.transform(runs, one), "")


def decode(df, content: str, replace: str | None = None, out: str = "decoded"):
    """`df` with the decoded text of column `content`; null content gives null."""
    mapping = replacement_map(F.col(replace)) if replace else F.create_map().cast("map<string,string>")
    c = F.col(content)
    odd = c.rlike(SURROGATE)
    df = once(df, {"__toks": F.when(odd, tokens(c)), "__runs": F.when(~odd, F.regexp_extract_all(c, F.lit(RUN), 0)), "__map": mapping})
    return df.withColumn(out, F.coalesce(emit_runs(F.col("__runs"), F.col("__map")), emit(F.col("__toks"), F.col("__map")))).drop("__toks", "__runs", "__map")


def unwrap(raw: Column) -> Column:
    """The JSON object inside a function call at the end of the text; null where there is none."""
    return F.nullif(F.regexp_extract(raw, WRAPPED, 1), F.lit(""))


def payload(raw: Column) -> Column:
    """struct(content, replace) of a wrapped payload; raw control characters in its strings are allowed."""
    parsed = F.from_json(unwrap(raw), "content string, replace map<string,string>", {"allowUnquotedControlChars": "true"})
    return F.struct(parsed["content"].alias("content"), F.coalesce(parsed["replace"], F.create_map().cast("map<string,string>")).alias("replace"))


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first character in which two texts differ, the lesser length if one begins the other, null if equal."""
    n = F.least(F.length(a), F.length(b))
    # the common beginning grows by halving blocks: 31 comparisons whatever the length
    blocks = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    grow = lambda same, k: F.when((same + k <= n) & (F.substring(a, same + 1, k) == F.substring(b, same + 1, k)), same + k).otherwise(same)
    return F.when(a == b, F.lit(None)).when(a.isNull() | b.isNull(), n).otherwise(F.aggregate(blocks, F.lit(0), grow)).cast("long")
