"""What becomes of duplicate books: groups, a ledger over time, restores; books of one title whose texts differ; titles of other books.

Pairs come from `books.duplicate_pairs`, between representatives of texts with the same sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normal_title, sentences
from ..sources.tables import written
from . import books
from .groups import connected

ACTIONS = ("keep", "move", "review")


# -- groups -----------------------------------------------------------------------------------


def classes(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per document: the id, its group (the least id that pairs reach from it; its own without any) and its number of pairs."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    links = ends.groupBy("id").agg(F.count("*").alias("links"))
    roots = connected(pairs)
    found = links.join(roots, "id").withColumnRenamed("id", "__id")
    return docs.select(id_col).join(found, F.col(id_col) == F.col("__id"), "left").select(id_col, F.coalesce("root", id_col).alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def actions(verdicts: DataFrame, sizes: DataFrame, running: DataFrame | None = None, approved: DataFrame | None = None) -> DataFrame:
    """(group, id, action) of every member of a group of pairs (a, b, verdict) whose verdict is same, subset or review.

    The largest text of a group is kept, at a tie the least id. Another is moved if a text that is larger (at a tie of lesser
    id) is the same or holds it, or if it is approved; else it is up for review. Texts still running are left out, and
    pairs with them; a text kept is never moved, also if approved.
    """
    told = verdicts.where(F.col("verdict").isin("same", "subset", "review"))
    if running is not None:
        for side in ("a", "b"):
            told = told.join(running.select(F.col("id").alias(side)), side, "left_anti")
    size = lambda side: sizes.select(F.col("id").alias(side), F.col("chars").alias(f"{side}_chars"))
    told = written(told.join(size("a"), "a").join(size("b"), "b").select("a", "b", "verdict", "a_chars", "b_chars"))
    wins = (F.col("a_chars") > F.col("b_chars")) | ((F.col("a_chars") == F.col("b_chars")) & (F.col("a") < F.col("b")))
    auto = F.col("verdict").isin("same", "subset")
    losers = told.where(auto).select(F.when(wins, F.col("b")).otherwise(F.col("a")).alias("id")).distinct().withColumn("__auto", F.lit(True))
    members = connected(told).withColumnRenamed("root", "group").join(sizes.select("id", "chars"), "id")
    best = members.groupBy("group").agg(F.max_by("id", F.struct("chars", -F.col("id"))).alias("__best"))
    out = members.join(best, "group").join(losers, "id", "left")
    ok = F.lit(False)
    if approved is not None:
        out = out.join(approved.select("id").distinct().withColumn("__ok", F.lit(True)), "id", "left")
        ok = F.coalesce("__ok", F.lit(False))
    action = F.when(F.col("id") == F.col("__best"), "keep").when(F.coalesce("__auto", F.lit(False)) | ok, "move").otherwise("review")
    return out.select("group", "id", action.alias("action"))


def merged_ledger(old: DataFrame, new: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """(group, status, to_move, to_review): the ledger (group, status) after a scan that found `new` (group, id, action).

    "ignored" lasts. "cleaned" lasts while nothing is to be done in the group and falls back to "open" otherwise. What was moved
    (id) is not to be done again; a group all of whose work is done is "cleaned". A group that is no longer found keeps its status,
    but an open one goes.
    """
    todo = new.where("action <> 'keep'")
    if moved is not None:
        todo = todo.join(moved.select("id").distinct(), "id", "left_anti")
    per = todo.groupBy("group").agg(F.count_if(F.col("action") == "move").alias("to_move"), F.count_if(F.col("action") == "review").alias("to_review"))
    seen = new.select("group").distinct().join(per, "group", "left").na.fill(0, ["to_move", "to_review"]).withColumn("__seen", F.lit(True))
    both = old.select("group", F.col("status").alias("__old")).join(seen, "group", "full_outer").na.fill(0, ["to_move", "to_review"])
    busy = (F.col("to_move") + F.col("to_review")) > 0
    status = F.when(F.col("__old") == "ignored", "ignored").when(busy, "open").when(F.col("__seen") | (F.col("__old") == "cleaned"), "cleaned")
    return both.select("group", status.alias("status"), "to_move", "to_review").where(F.col("status").isNotNull())


def restored_names(quarantined: DataFrame, present: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """`quarantined` with `restored`, a name that no file present in its folder has and no other restored file gets: its own if
    free, else with " (restored n)" before the extension. Names that leave their folder are refused: null."""
    stem, ext = F.regexp_extract(name, "^(.*?)(?: \\(restored [0-9]+\\))?(\\.[^.]*)?$", 1), F.regexp_extract(name, "(\\.[^.]*)$", 1)
    used = present.select(F.col(folder).alias("__f"), F.col(name).alias("__n"))
    taken = used.select("__f", F.regexp_extract("__n", "^(.*?)(?: \\(restored [0-9]+\\))?(\\.[^.]*)?$", 1).alias("__s"), F.regexp_extract("__n", "(\\.[^.]*)$", 1).alias("__e"), F.coalesce(F.regexp_extract("__n", " \\(restored ([0-9]+)\\)(?:\\.[^.]*)?$", 1).try_cast("long"), F.lit(0)).alias("__k"))
    most = taken.groupBy("__f", "__s", "__e").agg(F.max("__k").alias("__most"))
    sound = F.col(name).isNotNull() & ~F.col(name).rlike("[/\\\\]") & ~F.col(name).isin("", ".", "..")
    marked = quarantined.withColumn("__s", stem).withColumn("__e", ext).withColumn("__f", F.col(folder))
    marked = marked.join(most, ["__f", "__s", "__e"], "left")
    place = F.row_number().over(Window.partitionBy("__f", "__s", "__e").orderBy(name))
    free = F.col("__most").isNull() & (place == 1)
    number = F.coalesce("__most", F.lit(0)) + place - F.when(F.col("__most").isNull(), 1).otherwise(0)
    new = F.when(free, F.concat("__s", "__e")).otherwise(F.concat("__s", F.lit(" (restored "), number.cast("string"), F.lit(")"), "__e"))
    return marked.withColumn("restored", F.when(sound, new)).drop("__f", "__s", "__e", "__most")


# -- titles -----------------------------------------------------------------------------------


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))


#: Words of 64 bits that tell which title pieces are asked for.
MARKS = 1 << 18


def title_parts(titles: DataFrame) -> DataFrame:
    """(small, big) of different titles (column `title`, unique and not empty) of which one holds the other.

    An inverted index over pieces of 1, 2 and 6 characters: a title looks for its rarest piece of the longest size it has, which
    each title that holds it has too; what is found is checked. How rare a piece is, and whether any title looks for it, is told
    by summaries of a fixed size (others may fall on the same place, which costs a look only), so few pieces are shuffled.
    """
    sized = titles.select("title", F.length("title").alias("n"))
    pieces = lambda size: sized.where(F.col("n") >= size).select("title", F.lit(size).alias("size"), F.explode(_grams(F.col("title"), size)).alias("piece"))
    index = pieces(1).unionByName(pieces(2)).unionByName(pieces(6)).select("title", "size", F.xxhash64("size", "piece").alias("piece"))
    index = index.withColumn("spot", F.shiftrightunsigned("piece", 48))
    often = index.groupBy("spot").agg(F.count("*").alias("times"))
    own = F.when(F.length("title") >= 6, 6).when(F.length("title") >= 2, 2).otherwise(1)
    asks = index.where(F.col("size") == own).join(F.broadcast(often), "spot")
    asks = written(asks.groupBy(F.col("title").alias("small")).agg(F.min_by("piece", "times").alias("piece")))  # of several as rare, any will do
    mark, bit = F.shiftrightunsigned("piece", 6) % MARKS, "cast(piece & 63 as int)"
    asked = asks.groupBy(mark.alias("mark")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("marks"))
    index = index.withColumn("mark", mark).join(F.broadcast(asked), "mark").where(f"shiftright(marks, {bit}) & 1 = 1")
    found = asks.hint("merge").join(index.select("piece", F.col("title").alias("big")), "piece")  # an index is larger than its titles, which Spark goes by
    return found.where((F.col("small") != F.col("big")) & F.col("big").contains(F.col("small"))).select("small", "big")


#: Sentences of a block of titles; how many are looked up at once.
BLOCK, LOOKS = 1 << 19, 1 << 20


class _Home(books.Block):
    """The texts (id, title, chars, n, set) of a block of titles, and how many partners each has. Hashes are told apart by title."""

    def __init__(self, texts: pa.Table, ratio: int, most: float):
        super().__init__(texts)
        self.ratio, self.most = ratio, most
        title, self.chars, self.n = (self.texts.column(c).to_numpy() for c in ("title", "chars", "n"))
        self.h = self.h ^ np.repeat(title, self.count)
        self.sort()
        # texts by title and size, as numbers of one line: those of a title within a range of sizes are a stretch of it
        self.titles, self.of = np.unique(title, return_inverse=True)
        self.width = int(self.chars.max(initial=0)) + 1
        place = self.of * self.width + self.chars
        self.order = np.argsort(place, kind="stable")
        self.line = place[self.order]
        self.steps = np.zeros(len(place) + 1, np.int64)  # where stretches begin and end
        self.partners = np.zeros(len(place), np.int64)
        low, high = self._stretch(self.of, self.chars)
        self.partners += high - low - 1
        for i, j, both in books.counted(self, self, 1, True):
            good = self._alike(self.chars[i], self.n[i], j, both)
            for side in (i, j):
                self.partners -= np.bincount(side[good], minlength=len(place))

    def _stretch(self, of: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, greatest = np.ceil(chars / self.ratio).astype(np.int64), np.floor(chars * self.ratio).astype(np.int64)
        low = np.searchsorted(self.line, of * self.width + np.minimum(least, self.width), "left")
        return low, np.searchsorted(self.line, of * self.width + np.minimum(greatest, self.width - 1), "right")

    def _alike(self, chars: np.ndarray, n: np.ndarray, j: np.ndarray, both: np.ndarray) -> np.ndarray:
        small, large = np.minimum(chars, self.chars[j]), np.maximum(chars, self.chars[j])
        return (large <= self.ratio * small) & (both / (n + self.n[j] - both) >= self.most)

    def meet(self, rows: pa.Table) -> pa.RecordBatch:
        """Texts from elsewhere and the titles of this block that they are for: the row of kind 1 before texts of kind 2, the
        text's own for kind 3. Texts here are counted with them; returned are their ids and partners."""
        rows = rows.combine_chunks()
        kind, title, chars, n = (pc.fill_null(rows.column(c), 0).to_numpy() for c in ("kind", "title", "chars", "n"))
        sets = rows.column("set").combine_chunks()
        flat = np.concatenate([sets.flatten().to_numpy(zero_copy_only=False), title])
        size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        text = np.flatnonzero(kind > 1)
        list_at = np.maximum.accumulate(np.where(kind == 1, np.arange(len(kind)), 0))[text]
        alone = kind[text] == 3
        first = np.where(alone, len(flat) - len(title) + text, start[list_at])
        times = np.where(alone, 1, size[list_at])
        looks = np.maximum(size[text], 1)
        to, work = np.cumsum(times), np.cumsum(times * looks)
        got = np.zeros(len(text), np.int64)
        ends = np.arange(0, work[-1] + 1 if len(work) else 0, LOOKS)
        row = np.searchsorted(work, ends, "right")
        row = np.minimum(row, len(text) - 1)
        cut = to[row] - times[row] + (ends - work[row] + times[row] * looks[row]) // looks[row] if len(text) else ends
        for begin, end in zip(cut, [*cut[1:], to[-1] if len(to) else 0]):
            v = np.arange(begin, end)
            k = np.searchsorted(to, v, "right")
            big = flat[first[k] + v - (to[k] - times[k])]
            of = np.searchsorted(self.titles, big)
            here = np.flatnonzero(self.titles[np.minimum(of, len(self.titles) - 1)] == big) if len(self.titles) else np.zeros(0, np.int64)
            k, big, of = k[here], big[here], of[here]
            low, high = self._stretch(of, chars[text[k]])
            some = np.flatnonzero(high > low)
            k, big, low, high = k[some], big[some], low[some], high[some]
            got += np.bincount(k, high - low, minlength=len(got)).astype(np.int64)
            np.add.at(self.steps, low, 1)
            np.add.at(self.steps, high, -1)
            guest = text[k]
            asked = books.Looks(flat, start[guest], size[guest], big)
            for i, j, both in books.counted(asked, self, 1, False):
                good = self._alike(chars[guest[i]], n[guest[i]], j, both)
                got -= np.bincount(k[i[good]], minlength=len(got))
                self.partners -= np.bincount(j[good], minlength=len(self.partners))
        return _sums(rows.column("id").take(text), got)

    def all(self) -> pa.RecordBatch:
        self.partners[self.order] += np.cumsum(self.steps)[:-1]
        return _sums(self.texts.column("id"), self.partners)


def _sums(ids: pa.ChunkedArray, partners: np.ndarray) -> pa.RecordBatch:
    some = partners != 0
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids.filter(pa.array(some)).chunks or [pa.array([], ids.type)]), pa.array(partners[some])], names=["id", "partners"])


def _partners(sized: DataFrame, parts: DataFrame, ratio: int, most: float) -> DataFrame:
    """(id, partners): with how many others of its title, or of one that holds it or that it holds (title, big), a text (id,
    title, chars, n, set; titles as hashes) has a Jaccard similarity below `most`, where neither is more than `ratio` times as large.

    Titles are dealt into blocks of some half a million sentences, a larger one into several, and a text stands in one. The
    texts of a title also go to each block that has titles which hold it, once and with the list of those, however many they are;
    the pairs are counted there for both sides. So no pair of texts makes a row, and a task holds one block and a batch of guests.
    """
    blocks = max(books.BLOCKS, -(-(sized.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    large = sized.groupBy("title").agg(F.ceil(F.sum("n") / BLOCK).alias("pieces")).where("pieces > 1")  # no more than there are blocks
    large = F.broadcast(written(large))
    pieces = lambda c: F.coalesce(c, F.lit(1))
    block = lambda title, k: F.pmod(F.pmod(title, F.lit(blocks)) + k, F.lit(blocks))
    columns = ["block", "kind", "title", "id", "chars", "n", "set"]
    placed = sized.join(large, "title", "left").withColumn("piece", F.pmod(F.xxhash64("id"), pieces(F.col("pieces"))))
    home = placed.select(block(F.col("title"), F.col("piece")).alias("block"), F.lit(0).alias("kind"), *columns[2:])
    later = placed.where("pieces > piece + 1").withColumn("k", F.explode(F.sequence(F.col("piece") + 1, F.col("pieces") - 1)))
    later = later.select(block(F.col("title"), F.col("k")).alias("block"), F.lit(3).alias("kind"), *columns[2:])
    bigs = parts.join(large.withColumnRenamed("title", "big"), "big", "left").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), pieces(F.col("pieces")) - 1)))
    bigs = written(bigs.groupBy("title", block(F.col("big"), F.col("k")).alias("block")).agg(F.collect_list("big").alias("set")))
    lists = bigs.select("block", F.lit(1).alias("kind"), "title", *(F.lit(None).cast(sized.schema[c].dataType).alias(c) for c in ("id", "chars", "n")), "set")
    guests = bigs.select("title", "block").join(sized, "title").select("block", F.lit(2).alias("kind"), *columns[2:])
    dealt = home.unionByName(later).unionByName(lists).unionByName(guests)
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", F.col("kind") > 0, "title", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, now, last = [], None, None, None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | ((kind[1:] > 0) != (kind[:-1] > 0))) + 1).tolist(), len(block)]
            for low, high in zip(cuts, cuts[1:]):
                if high == low:
                    continue
                if now is not None and block[low] != now:
                    yield (found or _Home(pa.Table.from_batches(held, batch.schema), ratio, most)).all()
                    held, found, last = [], None, None
                now, part = block[low], batch.slice(low, high - low)
                if kind[low] == 0:
                    held.append(part)
                    continue
                found = found or _Home(pa.Table.from_batches(held, batch.schema), ratio, most)
                held = []
                yield found.meet(pa.Table.from_batches([*([last] if last else []), part]))
                if len(lists := np.flatnonzero(kind[low:high] == 1)):
                    last = part.slice(int(lists[-1]), 1)
        if now is not None:
            yield (found or _Home(pa.Table.from_batches(held, batch.schema), ratio, most)).all()

    return dealt.mapInArrow(run, f"id {sized.schema['id'].dataType.simpleString()}, partners long").groupBy("id").agg(F.sum("partners").alias("partners"))


def same_title_other_text(docs: DataFrame, id_col: str, title_col: str, text_col: str, least_chars: int = 500, ratio: int = 3, most: float = 0.05) -> DataFrame:
    """(id, partners): texts with others of the same title (or one that holds the other) that share hardly a sentence (Jaccard
    below `most`), are at most `ratio` times as large, and have `least_chars` letters and digits like itself. Such texts are
    versions to be kept, both; nothing here is ever moved.

    No pair of texts makes a row: partners are counted by size within related titles, and those with much in common, which
    tasks count by blocks of titles, are subtracted. A pair that shares nothing counts as 0. Titles and sentences are compared by
    hashes of 64 bits, whether a title holds another by their characters.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), normal_title(F.col(title_col)).alias("known"), F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", "")).cast("long").alias("chars"), text.alias("text"))
    sized = sized.where((F.coalesce(F.col("known"), F.lit("")) != "") & (F.col("chars") >= least_chars))
    sized = sized.withColumn("set", F.transform(F.array_distinct(sentences(F.col("text"))), lambda x: F.xxhash64(x))).withColumn("n", F.size("set").cast("long"))
    named = lambda c: F.xxhash64(F.lit("title"), c)  # noqa: E731  never a sentence's hash
    sized = written(sized.drop("text").withColumn("title", named(F.col("known"))))
    parts = title_parts(written(sized.select(F.col("known").alias("title")).distinct()))
    parts = parts.select(named(F.col("small")).alias("title"), named(F.col("big")).alias("big"))
    found = _partners(sized.drop("known"), parts, ratio, most)
    return found.where("partners > 0").select(F.col("id").alias(id_col), "partners")


def foreign_titles(chapters: DataFrame, books: DataFrame, folder: str = "folder", book: str = "book", title: str = "title", least: int = 2) -> DataFrame:
    """(folder, book, title, foreign): chapter titles that hold the title of another book of the folder, both in normal form.

    Titles of books are looked up, not compared: of each chapter title the pieces of the lengths that titles of its folder have
    (`least` or more) meet the titles by equality. Equal titles of several books are one; a book's own title is none, even within
    a longer one that is.
    """
    own = books.select(F.col(folder).alias("folder"), F.col(book).alias("owner"), normal_title(F.col(title)).alias("known")).where(F.length("known") >= least)
    lengths = own.groupBy("folder").agg(F.array_sort(F.collect_set(F.length("known"))).alias("lengths"))  # a number per length
    given = chapters.select(F.col(folder).alias("folder"), F.col(book).alias("__book"), F.col(title).alias("__title"), normal_title(F.col(title)).alias("normal")).distinct()
    span = lambda n: F.transform(F.sequence(F.lit(1), F.col("normal_n") - n + 1), lambda i: F.substr(F.col("normal"), i, n))
    fits = F.filter("lengths", lambda n: n <= F.col("normal_n"))
    pieces = given.withColumn("normal_n", F.length("normal")).join(lengths, "folder").select("folder", "__book", "__title", F.explode(F.array_distinct(F.flatten(F.transform(fits, span)))).alias("known"))
    met = pieces.join(own, ["folder", "known"])
    found = met.groupBy("folder", "__book", "__title", "known").agg(F.max(F.col("owner").eqNullSafe(F.col("__book"))).alias("mine")).where("not mine")
    return found.select(F.col("folder").alias(folder), F.col("__book").alias(book), F.col("__title").alias(title), F.col("known").alias("foreign"))
