"""The quality report of a text, as column functions.

Five scores (length, share of the expected script, garble, repeated lines, punctuation density)
add up to 100; hard faults give reasons. A null or blank text scores 0 with the one reason
"empty" and canonical statistics. Everything is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import chars


@dataclass(frozen=True)
class QualityRules:
    """Thresholds and weights; `script` is the expected script's class."""

    script: tuple = chars.CJK
    short: int = 200
    full: int = 500
    script_hard: float = 0.30
    script_good: float = 0.60
    garble_good: float = 0.05
    garble_hard: float = 0.30
    repeat_good: float = 0.40
    marks_low: float = 0.02
    marks_high: float = 0.25
    marks_least: float = 0.005
    marks_most: float = 0.40
    weights: tuple[float, float, float, float, float] = (25.0, 25.0, 20.0, 15.0, 15.0)
    passing: float = 60.0


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, chars.TRIM_JAVA, "")


def trimmed_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), trim), lambda x: x != "")


def count_class(text: Column, *classes) -> Column:
    """Characters of the classes: what is left when the runs of others go, as runs are fewer than characters."""
    return F.length(F.regexp_replace(text, f"{chars.quick(*classes, negate=True)}++", ""))


def garble_run_length(text: Column, least: int = 4) -> Column:
    """Characters in runs of `least` or more that are neither script, ASCII letters or digits, space nor punctuation."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{chars.quick(*chars.ALLOWED, negate=True)}{{{least},}}+", ""))


def half_up(x: Column, digits: int = 1) -> Column:
    """Rounds non-negative numbers half away from zero."""
    m = float(10**digits)
    return F.floor(x * m + 0.5) / F.lit(m)


def stats_columns(text: str, rules: QualityRules = QualityRules()) -> dict[str, Column]:
    """First step: counts."""
    t = F.col(text)
    lines = trimmed_lines(t)
    return {
        "q_blank": F.coalesce(trim(t) == "", F.lit(True)),
        "q_net": F.length(t).cast("long"),
        "q_lines": F.size(lines).cast("long"),
        "q_distinct": F.size(F.array_distinct(lines)).cast("long"),
        "q_script": count_class(t, rules.script).cast("long"),
        "q_garbage": (count_class(t, chars.GARBAGE) + garble_run_length(t)).cast("long"),
        "q_marks": count_class(t, chars.ranges(chars.PUNCTUATION)).cast("long"),
        "q_feeds": F.regexp_count(t, F.lit("\n")).cast("long"),
    }


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with the columns, worked out once a row: behind a generator the optimizer does not repeat
    their expressions in later filters and lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_stats(df: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """net, lines, cjk, garble, dup, punct and blank of each text."""
    df = once(df, stats_columns(text, rules))
    empty = F.col("q_blank")
    per_char = lambda c: F.col(c) / F.col("q_net")
    return df.withColumns({
        "net": F.when(empty, F.lit(0)).otherwise(F.col("q_net")).cast("long"),
        "lines": F.when(empty, F.lit(0)).otherwise(F.col("q_lines")).cast("long"),
        "cjk": F.when(empty, 0.0).otherwise(per_char("q_script")),
        "garble": F.when(empty, 1.0).otherwise(per_char("q_garbage")),
        "dup": F.when(empty | (F.col("q_lines") == 0), 1.0).otherwise(1.0 - F.col("q_distinct") / F.col("q_lines")),
        "punct": F.when(empty, 0.0).otherwise(per_char("q_marks")),
        "blank": F.when(empty | (F.col("q_feeds") == 0), 0.0).otherwise((F.col("q_feeds") + 1 - F.col("q_lines")) / (F.col("q_feeds") + 1)),
    })


def length_score(net: Column, r: QualityRules) -> Column:
    return F.when(net >= r.full, r.weights[0]).when(net >= r.short, half_up(r.weights[0] * (net - r.short) / (r.full - r.short))).otherwise(0.0)


def script_score(share: Column, r: QualityRules) -> Column:
    return F.when(share >= r.script_good, r.weights[1]).when(share >= r.script_hard, half_up(r.weights[1] * (share - r.script_hard) / (r.script_good - r.script_hard))).otherwise(0.0)


def garble_score(rate: Column, r: QualityRules) -> Column:
    return F.when(rate <= r.garble_good, r.weights[2]).when(rate <= r.garble_hard, half_up(r.weights[2] * (r.garble_hard - rate) / (r.garble_hard - r.garble_good))).otherwise(0.0)


def repeat_score(rate: Column, r: QualityRules) -> Column:
    return F.when(rate <= r.repeat_good, r.weights[3]).otherwise(0.0)


def marks_score(density: Column, r: QualityRules) -> Column:
    half = ((density >= r.marks_least) & (density < r.marks_low)) | ((density > r.marks_high) & (density <= r.marks_most))
    return F.when((density >= r.marks_low) & (density <= r.marks_high), r.weights[4]).when(half, half_up(F.lit(r.weights[4] * 0.5))).otherwise(0.0)


def percent(x: Column, digits: int = 0) -> Column:
    """x * 100 in decimal notation, rounded half to even."""
    return F.bround(x * 100, digits).cast(f"decimal(12,{digits})").cast("string")


def with_report(df: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """`df` with score, valid, reasons and the statistics."""
    r = rules
    df = with_stats(df, text, r).withColumns({"s_length": length_score(F.col("net"), r), "s_script": script_score(F.col("cjk"), r), "s_garble": garble_score(F.col("garble"), r), "s_repeat": repeat_score(F.col("dup"), r), "s_marks": marks_score(F.col("punct"), r)})
    hard = [
        F.when(F.col("garble") > r.garble_hard, F.concat(F.lit("乱码率"), percent(F.col("garble")), F.lit(f"%>{r.garble_hard * 100:.0f}%"))),
        F.when(F.col("cjk") < r.script_hard, F.concat(F.lit("中文占比"), percent(F.col("cjk")), F.lit(f"%<{r.script_hard * 100:.0f}%"))),
    ]
    df = df.withColumn("q_hard", F.array_compact(F.array(*hard)))
    no_reason = F.size("q_hard") == 0
    short = (F.col("s_length") == 0) & no_reason
    soft = [
        F.when(short, F.concat(F.lit("长度不足("), F.col("net").cast("string"), F.lit("字)"))),
        F.when((F.col("s_script") == 0) & (F.col("cjk") >= r.script_hard) & no_reason & ~short, F.concat(F.lit("中文占比"), percent(F.col("cjk")), F.lit("%"))),
        F.when((F.col("s_garble") == 0) & (F.col("garble") <= r.garble_hard), F.concat(F.lit("乱码率"), percent(F.col("garble")), F.lit("%"))),
        F.when(F.col("s_repeat") == 0, F.concat(F.lit("重复率"), percent(F.col("dup")), F.lit("%"))),
        F.when(F.col("s_marks") == 0, F.concat(F.lit("标点密度"), percent(F.col("punct"), 1), F.lit("%"))),
    ]
    total = F.col("s_length") + F.col("s_script") + F.col("s_garble") + F.col("s_repeat") + F.col("s_marks")
    df = df.withColumns({
        "score": F.when(F.col("q_blank"), 0.0).otherwise(half_up(total)),
        "reasons": F.when(F.col("q_blank"), F.array(F.lit("正文为空"))).otherwise(F.concat("q_hard", F.array_compact(F.array(*soft)))),
    })
    df = df.withColumn("valid", (F.col("score") >= r.passing) & (F.size("reasons") == 0))
    return df.drop("q_blank", "q_net", "q_lines", "q_distinct", "q_script", "q_garbage", "q_marks", "q_feeds", "q_hard")
