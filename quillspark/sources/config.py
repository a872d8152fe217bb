"""Site rules from JSON files of several folders, and what they do."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RULES = "domain string, enabled boolean, tier_cap int, ua string, content_selectors array<string>, content_pagination string, ad_rules struct<keywords: array<string>, line_regex: array<string>>"


def site_rules(spark: SparkSession, folders: list[str], schema: str = RULES) -> DataFrame:
    """A row per domain from JSON files (an array of rules, or one) in folders by priority: of each field the first folder that gives
    it counts, so a rule adds to those behind it or replaces parts of them. `enabled` is true where nobody says
    otherwise. A file that is no JSON is passed over, and rules without a domain are."""
    parts = [spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f).withColumn("__rank", F.lit(k)) for k, f in enumerate(folders)]
    rows = reduce(DataFrame.unionByName, parts).where(F.coalesce(F.col("domain"), F.lit("")) != "").withColumn("domain", F.lower("domain"))
    fields = [c for c in rows.columns if c not in ("domain", "__rank")]
    # of two rules of one folder for a domain the one whose text comes first, so that the result does not hang on the order of files
    order = F.struct("__rank", F.to_json(F.struct(*fields)))
    merged = rows.groupBy("domain").agg(*[F.min_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c))), F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields])
    return merged.select("domain", *[(F.coalesce(F.col(f"{c}.{c}"), F.lit(True)) if c == "enabled" else F.col(f"{c}.{c}")).alias(c) for c in fields])


def legal(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that Spark can compile; others are left out, as one that cannot be compiled would fail the query."""
    found = []
    for p in patterns:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(p)
        except (Py4JJavaError, PySparkException):
            continue
        found.append(p)
    return found


def without_ads(text: Column, domain: Column, rules: DataFrame, keywords: list[str], patterns: list[str] = (), most: int = 10_000) -> Column:
    """Lines without those that hold a keyword or match a pattern, built-in ones and, of texts of a domain, its own. Rules only add.
    `rules` is a configuration of `most` domains at most, read on the driver; illegal patterns are skipped."""
    spark = rules.sparkSession
    rows = rules.where("enabled and ad_rules is not null").select("domain", "ad_rules.*").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} domains have rules of their own")
    words: dict[str, list[str]] = {}
    for r in rows:
        own = [*(r.keywords or []), *(f"\x00{p}" for p in legal(spark, list(r.line_regex or [])))]
        if own:
            words[r.domain] = own
    usual = legal(spark, list(patterns))

    def hit(line: Column) -> Column:
        found = reduce(lambda a, b: a | b, [*(line.contains(k) for k in keywords), *(line.rlike(p) for p in usual)], F.lit(False))
        for name, own in words.items():
            mine = reduce(lambda a, b: a | b, [line.rlike(w[1:]) if w.startswith("\x00") else line.contains(w) for w in own])
            found = found | (((domain == name) | domain.endswith(f".{name}")) & mine)
        return F.coalesce(found, F.lit(False))

    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~hit(x)), "\n")
