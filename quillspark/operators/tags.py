"""Elements of landed pages as intervals of their tokens, with parents, and the block that is most like the content.

A page's tokens are numbered; the level of a tag among the tags of its name is a running sum, and an
end tag closes the start tag of its level before it. So elements nest at any depth, and an element
that nothing closes ends with the page. All measures are differences of running sums; windows are
by page, so one shuffle by page does for all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import chars, markup
from .catalogs import damped_parents

CONTAINERS = ("article", "section", "div", "main", "td", "nav", "header", "footer", "body")


@dataclass(frozen=True)
class BlockRules:
    """Weights of a block's score; all ours but the gate and the damping."""

    script: tuple = chars.CJK
    full_letters: float = 1000.0
    full_paragraphs: float = 5.0
    letters: float = 0.6
    paragraphs: float = 0.4
    links: float = 0.5
    depth: float = 0.02
    gate: float = 0.55
    child_share: float = 0.9
    damping: float = 0.6


def tag_events(pages: DataFrame, page: str = "page_id", html: str = "html", script: tuple = chars.CJK) -> DataFrame:
    """(page, pos, name, opens, token, letters, linked, paragraphs): every token with the sums, up to and with it, of letters
    of the script outside tags, of those inside links, and of paragraphs begun."""
    each = pages.select(F.col(page).alias("page"), F.posexplode(markup.tokens(F.col(html))).alias("pos", "token"))
    each = each.select("page", F.col("pos").cast("long").alias("pos"), "token", markup.tag_name(F.col("token")).alias("name"), markup.opens(F.col("token")).alias("opens"))
    own = F.when(F.col("token").startswith("<"), 0).otherwise(F.length(F.regexp_replace("token", chars.java(script, negate=True), "")))
    order = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("own", own).withColumn("in_link", F.sum(F.when(F.col("name") == "a", F.col("opens")).otherwise(0)).over(order))
    begins = (F.col("name") == "p") & (F.col("opens") == 1)
    sums = {"letters": F.col("own"), "linked": F.when(F.col("in_link") > 0, F.col("own")).otherwise(0), "paragraphs": begins.cast("int")}
    return each.select("page", "pos", "name", "opens", "token", *[F.sum(c).over(order).alias(k) for k, c in sums.items()])


def elements(events: DataFrame, names: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """(page, start, end, name, token, letters, linked, paragraphs, depth, parent): each element of these names, measured inside;
    `parent` is the start of the innermost of them around it."""
    sums = ("letters", "linked", "paragraphs")
    whole = Window.partitionBy("page")
    marked = events.withColumn("page_end", F.struct((F.max("pos").over(whole) + 1).alias("pos"), *[F.max(c).over(whole).alias(c) for c in sums]))
    marked = marked.where(F.col("name").isin(*names) & (F.col("opens") != 0))
    running = F.sum("opens").over(Window.partitionBy("page", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    level = running + F.when(F.col("opens") < 0, 1).otherwise(0)
    after = F.lead(F.struct("opens", "pos", *sums)).over(Window.partitionBy("page", "name", "level").orderBy("pos"))
    closing = F.when(F.col("after.opens") < 0, F.struct("after.pos", *[f"after.{c}" for c in sums])).otherwise(F.col("page_end"))
    found = marked.withColumn("level", level).withColumn("after", after).where("opens > 0").withColumn("close", closing)
    found = found.select("page", F.col("pos").alias("start"), F.col("close.pos").alias("end"), "name", "token", *[(F.col(f"close.{c}") - F.col(c)).alias(c) for c in sums])
    # how many elements are open where each begins
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("turn")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("turn"))))
    edges = found.select("*", ends.alias("edge")).withColumn("depth", F.sum("edge.turn").over(Window.partitionBy("page").orderBy("edge.at", "edge.turn").rowsBetween(Window.unboundedPreceding, 0)))
    deep = edges.where("edge.turn = 1").drop("edge")
    # the element of the depth above that began last
    roles = deep.select("*", F.explode(F.array(F.struct(F.col("depth").alias("lvl"), F.lit(True).alias("holds")), F.struct((F.col("depth") - 1).alias("lvl"), F.lit(False).alias("holds")))).alias("role"))
    parent = F.last(F.when(F.col("role.holds"), F.col("start")), ignorenulls=True).over(Window.partitionBy("page", "role.lvl").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return roles.withColumn("parent", parent).where("not role.holds").drop("role")


def scored(blocks: DataFrame, rules: BlockRules = BlockRules()) -> DataFrame:
    """`elements` with letters, scored by letters, paragraphs, share of links and depth; a block of which one child holds nearly
    all letters is only its wrapping, and damped."""
    r = rules
    score = r.letters * F.least(F.col("letters") / r.full_letters, F.lit(1.0)) + r.paragraphs * F.least(F.col("paragraphs") / r.full_paragraphs, F.lit(1.0))
    score = score - r.links * (F.col("linked") / F.col("letters")) - r.depth * F.col("depth")
    some = blocks.where("letters > 0").withColumn("score", score).withColumnRenamed("start", "block")
    return damped_parents(some, "page", r.child_share, r.damping)


def best_blocks(pages: DataFrame, page: str = "page_id", html: str = "html", rules: BlockRules = BlockRules()) -> DataFrame:
    """(page, block, name, depth, score) of the best block of each page that passes the gate; at a tie the first."""
    blocks = scored(elements(tag_events(pages, page, html, rules.script)), rules)
    best = blocks.groupBy("page").agg(F.max_by(F.struct("block", "name", "depth", "score"), F.struct("score", -F.col("block"))).alias("b"))
    return best.where(F.col("b.score") >= rules.gate).select(F.col("page").alias(page), "b.block", "b.name", "b.depth", "b.score")


def first_selected(pages: DataFrame, selectors: list[tuple], html: str = "html") -> DataFrame:
    """`pages` with `selector` and `inner`: the name and the tokens inside the element of the first selector (name, tag, and
    perhaps attribute and value) that finds one with any content. Null if none does."""
    name = inside = F.lit(None)
    parts = markup.tokens(F.col(html))
    found = pages.withColumn("__parts", parts)
    for k, (_, *selector) in enumerate(selectors):
        found = found.withColumn(f"__in{k}", F.array_join(markup.inner(F.col("__parts"), *selector), ""))
    for k in reversed(range(len(selectors))):
        hit = F.coalesce(F.col(f"__in{k}") != "", F.lit(False))
        name, inside = F.when(hit, selectors[k][0]).otherwise(name), F.when(hit, F.col(f"__in{k}")).otherwise(inside)
    return found.withColumn("selector", name.cast("string")).withColumn("inner", inside.cast("string")).drop("__parts", *[f"__in{k}" for k in range(len(selectors))])
