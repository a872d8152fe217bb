"""Exact Jaccard join of word n-gram sets by token-combination prefixes, and its components.

Every text's distinct shingles (hashes of five words) are ordered: rare ones first, then frequent
ones, each class by hash. With e = n - ceil(t * n) tokens that a partner may lack, a text indexes
* its first e + 1 rare tokens, one by one;
* and, if it has no more than e rare tokens, pairs of consecutive frequent tokens over a prefix
  extended to e + (1 - t) * n / t - 2 * rare + 4 frequent tokens.
Completeness: where both texts have rare tokens beyond e, or one has, the shorter prefix would hold
e + 1 tokens that the partner lacks unless one is shared. Where neither has and no rare token is
shared, the rare ones are all lacking; of consecutive frequent pairs a token that the partner
lacks breaks two and one that only the partner has breaks one, fewer than the prefix holds. Texts
of up to 20 shingles also index frequent tokens one by one, as rounding matters for them. So combinations grow
linearly with the text. Any split into classes is correct; the frequent class holds the tokens
counted `least` times or more by lossy counting over all texts (those that several texts of one
chunk of 2 MB have; the error is one per chunk), 2**20 at most, so its broadcast stays within 8 MB
at any size.

Texts of equal sets are one node, the set's 64-bit fingerprint. A map task sends each key once for
each hash range with one node, marked if it has more; only keys of two nodes come back as
postings. With a posting go the set's size and its room, the number of tokens that it can share
with a partner of this list: all of them under a single token, the frequent ones under a pair, as
a text with pairs has indexed all its rare tokens and a partner that shares one meets it there.
Two members are worth comparing only if the lesser room reaches the overlap that their sizes
demand, and so does a bound from bitmaps of the 256 hash cells that hold one, two or three of a
text's shingles; a member that no other room in its list can satisfy leaves the list. A list is
compared with one hub, the member with fewest tokens of its own, not pairwise: lists whose
members are then not all in one component go on without the nodes compared, with 8, 64, ... hubs
each round, until every pair of a list was compared, ruled out or is connected; of lists with the
same members one goes on. Each member knows its top list, the longest that it is in with the same
room. Two members with one top list are compared there and in no other list: their rooms are the
same in it, and both stay in it until they have been compared or are connected. A hub leaves a list
when all others of it have been compared or share the hub's top, so no pair is lost; a list whose
members all have one other top goes at once. So all links between different texts count, copies are never paired,
and no list is gathered. Before all that each member is compared in one list only, its longest, with
the hub among those that chose the same: this connects most groups of copies with a row a member. Candidates pass an exact filter first: the sums over 512 hash cells of
the lesser cell count bound the overlap from above. The rest are verified on whole texts, fetched
past a bitmap of the ids asked for (2 MB at any size); shingles are compared by their bytes there.
Links, components and fingerprints stay in tables.

Defined results: null and empty texts have no shingles and form their own component, as does each
of several rows with equal ids unless linked; a null id keeps a null component; with fewer than
five words the whole sequence is the shingle. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .scratch import Scratch
from .words import U64, Words, chunks, mix, same_spans, small_batches

SHINGLE, NUM, DEN = 5, 80, 100
SMALL = 20
CELLS, COARSE, LEVELS = 512, 256, 3
BITS = [f"b{k}" for k in range(LEVELS * COARSE // 64)] + ["beyond"]


class Sets:
    """The distinct shingles of each text of a column, ascending by hash within a text."""

    def __init__(self, column, k: int = SHINGLE):
        w = self.words = Words(column, lower=True)
        parts = [w.windows(k)]
        for short in range(1, k):
            starts, h = w.windows(short)
            own = w.count[w.doc[starts]] == short
            parts.append((starts[own], h[own]))
        starts, h = (np.concatenate(p) for p in zip(*parts))
        doc = w.doc[starts]
        order = np.lexsort((h, doc))
        h, doc, starts = h[order], doc[order], starts[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc, self.start = h[first], doc[first], starts[first]
        self.at = np.searchsorted(self.doc, np.arange(len(w.count) + 1))
        self.n = np.diff(self.at)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(self.h + U64(0x51ED270B)), dtype=U64)])
            self.print = mix((sums[self.at[1:]] - sums[self.at[:-1]]) + self.n.astype(U64)).view(np.int64)

    def cells(self) -> list[bytes]:
        """How many shingles fall into each cell of the hash range, up to 255."""
        out, cell = [], (self.h >> U64(50)).astype(np.int64) % CELLS
        for base in range(0, len(self.n), 512):
            a, b = self.at[base], self.at[min(base + 512, len(self.n))]
            rows = min(512, len(self.n) - base)
            counts = np.bincount((self.doc[a:b] - base) * CELLS + cell[a:b], minlength=rows * CELLS).reshape(rows, CELLS)
            out += [r.tobytes() for r in np.minimum(counts, 255).astype(np.uint8)]
        return out

    def levels(self) -> np.ndarray:
        """Rows of BITS: bitmaps of the coarse cells with at least one, two, three shingles, then the shingles beyond those."""
        out = np.zeros((len(self.n), len(BITS)), np.int64)
        cell = (self.h >> U64(50)).astype(np.int64) % COARSE
        for base in range(0, len(self.n), 512):
            a, b = self.at[base], self.at[min(base + 512, len(self.n))]
            rows = min(512, len(self.n) - base)
            counts = np.bincount((self.doc[a:b] - base) * COARSE + cell[a:b], minlength=rows * COARSE).reshape(rows, COARSE)
            for t in range(LEVELS):
                out[base : base + rows, t * COARSE // 64 : (t + 1) * COARSE // 64] = np.packbits(counts > t, axis=1).view(np.int64)
            out[base : base + rows, -1] = np.maximum(counts - LEVELS, 0).sum(1)
        return out

    def of(self, i: int) -> np.ndarray:
        return self.h[self.at[i] : self.at[i + 1]]

    def only(self, docs: np.ndarray) -> Sets:
        """The sets of the marked texts, in order."""
        out = object.__new__(Sets)
        keep = docs[self.doc]
        number = np.cumsum(docs) - 1
        out.words, out.h, out.doc, out.start = self.words, self.h[keep], number[self.doc[keep]], self.start[keep]
        out.n, out.print = self.n[docs], self.print[docs]
        out.at = np.concatenate([[0], np.cumsum(out.n)])
        return out


def _distinct(sets: Sets) -> Sets:
    """One text of each fingerprint, and none without shingles."""
    first = np.zeros(len(sets.n), bool)
    first[np.unique(sets.print, return_index=True)[1]] = True
    return sets.only(first & (sets.n > 0))


def keys(sets: Sets, frequent: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys (their lowest bit clear), the texts' numbers, and the rooms."""
    n, at, doc, h = sets.n, sets.at, sets.doc, sets.h
    spare = n - (num * n + den - 1) // den
    place = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
    common = frequent[place] == h if len(frequent) else np.zeros(len(h), bool)
    rank = lambda mask: (lambda c: c[:-1] - c[at[:-1]][doc])(np.concatenate([[0], np.cumsum(mask)]))
    rare = np.bincount(doc[~common], minlength=len(n))
    single = ~common & (rank(~common) <= spare[doc])
    open_ = rare <= spare
    level = rank(common)
    single |= common & (open_ & (n <= SMALL))[doc] & (level <= (spare - rare)[doc])
    reach = spare + n * (den - num) // num - 2 * rare + 4
    where = np.flatnonzero(common & open_[doc] & (level < reach[doc]))
    a, b = where[:-1], where[1:]
    pair = doc[a] == doc[b]
    a, b = a[pair], b[pair]
    with np.errstate(over="ignore"):
        double = mix(h[a] * U64(0x9E3779B97F4A7C15) + mix(h[b]) + U64(2))
        made = np.concatenate([mix(h[single] + U64(1)), double])
    of = np.concatenate([doc[single], doc[a]])
    room = n[of]
    room[int(single.sum()) :] -= rare[doc[a]]
    return made & ~U64(1), of, room


_FOUND = "kind int, h long, n long, doc_id {id}, size long, node long, cells binary, " + ", ".join(f"{c} long" for c in BITS)


def _survey(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Kind 0: a row for each text with its set's size and fingerprint. Kind 1: tokens that several
    different texts of one chunk have, with their number; kind 2: the chunk's number of tokens."""

    def run(batches):
        for batch in chunks(batches, text_col, 2 << 20):
            sets = Sets(batch.column(text_col))
            m = len(sets.n)
            ids = batch.column(id_col)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), none, none, ids, pa.array(sets.n.astype(np.int64)), pa.array(sets.print), pa.array(sets.cells(), pa.binary()), *map(pa.array, np.ascontiguousarray(sets.levels().T))], names=names)
            own = _distinct(sets)
            h, times = np.unique(own.h, return_counts=True)
            some = times > 1
            h, times = np.append(h[some], U64(0)), np.append(times[some], len(own.h))
            kind = np.ones(len(h), np.int32)
            kind[-1] = 2
            none = pa.nulls(len(h), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(h.view(np.int64)), pa.array(times.astype(np.int64)), pa.nulls(len(h), ids.type), none, none, pa.nulls(len(h), pa.binary()), *[none] * len(BITS)], names=names)

    names = ["kind", "h", "n", "doc_id", "size", "node", "cells", *BITS]
    return docs.select(id_col, text_col).mapInArrow(run, _FOUND.format(id=docs.schema[id_col].dataType.simpleString()))


def _frequent(survey: DataFrame, scratch: Scratch, most: int, least: int) -> np.ndarray:
    """At most `most` tokens, those counted `least` times or as often as the least bound that allows it."""
    counted = scratch.keep(survey.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    level = F.floor(4 * F.log2("n")).cast("int")  # a few hundred levels at most
    bound, seen = None, 0
    for row in counted.groupBy(level.alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect():
        if seen + row.c > most:
            break
        bound, seen = row.level, seen + row.c
    if bound is None:
        return np.zeros(0, U64)
    return np.sort(counted.where(level >= bound).select("h").toPandas()["h"].to_numpy(np.int64).view(U64))


_ROWS = ("keys", "nodes", "sizes", "rooms")
_KINDS = (U64, np.int64, np.int32, np.int32)


def _sent(docs: DataFrame, id_col: str, text_col: str, frequent: np.ndarray, width: int) -> DataFrame:
    """(bucket, keys, nodes, sizes, rooms): each chunk's keys by hash range; the further nodes of its shared keys are
    complete postings and get a bucket of their own beyond `width`, so they never meet those of other chunks."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def index(batches):
        for batch in chunks(batches, text_col, 2 << 20):
            sets = _distinct(Sets(batch.column(text_col)))
            key, doc, room = keys(sets, shared.value)
            node = sets.print[doc]
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            order, key, node = order[new], key[new], node[new]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            several = ~first
            shared_key = first.copy()
            shared_key[:-1] &= several[1:]
            shared_key[-1:] = False
            key = key | shared_key.astype(U64)  # the mark of a key with more nodes in this chunk
            columns = (key, node, sets.n[doc][order].astype(np.int32), room[order].astype(np.int32))
            bucket = np.where(first, ((key >> U64(20)) % U64(width)).astype(np.int64), width)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(width + 2))
            rows = [(b, *(c[o].tobytes() for c in columns)) for b in range(width + 1) if len(o := order[at[b] : at[b + 1]])]
            if rows and rows[-1][0] == width:
                with np.errstate(over="ignore"):
                    own = int(mix(key[several] + mix(node[several].view(U64))).sum(dtype=U64)) >> 2
                rows[-1] = (width + own, *rows[-1][1:])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=["bucket", *_ROWS])

    return docs.select(id_col, text_col).mapInArrow(index, "bucket long, " + ", ".join(f"{c} binary" for c in _ROWS))


def _postings(docs: DataFrame, id_col: str, text_col: str, frequent: np.ndarray, width: int) -> DataFrame:
    """(key, node, size, room) for all keys that two nodes have. A key's lowest bit is clear."""

    def match(table: pa.Table) -> pa.Table:
        key, node, size, room = (np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()]) for c, kind in zip(_ROWS, _KINDS))
        plain = key & ~U64(1)
        if table.column("bucket")[0].as_py() < width:
            order = np.lexsort((node, plain))
            key, node, plain, size, room = key[order], node[order], plain[order], size[order], room[order]
            new = np.ones(len(key), bool)
            new[1:] = (plain[1:] != plain[:-1]) | (node[1:] != node[:-1])
            group = np.cumsum(np.concatenate([[True], plain[1:] != plain[:-1]])) - 1
            many = np.bincount(group, new) > 1
            many |= np.bincount(group, (key & U64(1)).astype(np.int64)) > 0
            keep = new & many[group]
            plain, node, size, room = plain[keep], node[keep], size[keep], room[keep]
        return pa.table({"key": pa.array(plain.view(np.int64)), "node": pa.array(node), "size": pa.array(size), "room": pa.array(room)})

    return _sent(docs, id_col, text_col, frequent, width).groupBy("bucket").applyInArrow(match, "key long, node long, size int, room int")


def _plausible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that the cell counts allow, with the ids of their texts."""
    one = lambda side, *more: nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in more])
    rows = pairs.join(one("a", "rep", "size", "cells"), "a").join(one("b", "rep", "size", "cells"), "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, y = (np.frombuffer(b"".join(part.column(f"{c}_cells").to_pylist()), np.uint8).reshape(-1, CELLS) for c in "ab")
                least = np.minimum(x, y)
                sizes = part.column("a_size").to_numpy() + part.column("b_size").to_numpy()
                most = least.sum(1, dtype=np.int64)
                good = (least == 255).any(1) | (den * most >= num * (sizes - most))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good)) for c in names], names=names)

    names = ["a", "b", "a_rep", "b_rep"]
    kept = rows.select(*names, "a_size", "b_size", "a_cells", "b_cells")
    return kept.mapInArrow(run, kept.select(names).schema)


def _asked(docs: DataFrame, candidates: DataFrame, id_col: str, bits: int = 23) -> DataFrame:
    """`docs` without most of those that no candidate asks for: a bitmap of id hashes, of 2**bits bits, is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    ids = candidates.select(F.explode(F.array("a_rep", "b_rep")).alias("id")).select(place("id").alias("p"))
    bitmap = ids.groupBy(F.floor(F.col("p") / 64).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("__bits"))
    near = docs.withColumn("__p", place(F.col(id_col))).withColumn("__word", F.floor(F.col("__p") / 64))
    return near.join(F.broadcast(bitmap), "__word").where(F.expr("shiftrightunsigned(__bits, cast(__p % 64 as int)) & 1L = 1L")).drop("__p", "__word", "__bits")


def _overlaps(sa: Sets, ia: np.ndarray, sb: Sets, ib: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """How many shingles each pair of texts (ia[p], ib[p]) shares: found by hash, counted if their bytes are the same."""
    at, bt, pair = [], [], []
    for p, (i, j) in enumerate(zip(ia.tolist(), ib.tolist())):
        _, x, y = np.intersect1d(sa.of(i), sb.of(j), assume_unique=True, return_indices=True)
        at.append(sa.start[sa.at[i] + x])
        bt.append(sb.start[sb.at[j] + y])
        pair.append(np.full(len(x), p))
    if not at:
        return np.zeros(0, np.int64)
    at, bt, pair = np.concatenate(at), np.concatenate(bt), np.concatenate(pair)
    wa, wb = sa.words, sb.words
    na, nb = (np.minimum(w.count[w.doc[t]], k) for w, t in ((wa, at), (wb, bt)))
    same = na == nb
    for c in range(k):  # word by word; a text of fewer words has one shingle of them all
        live = np.flatnonzero(same & (c < na))
        x, y = at[live] + c, bt[live] + c
        size = wa.end[x] - wa.start[x]
        good = size == wb.end[y] - wb.start[y]
        good[good] = same_spans(wa.plain, wa.start[x[good]], wb.plain, wb.start[y[good]], size[good])
        same[live] = good
    return np.bincount(pair[same], minlength=len(ia))


def _verify(candidates: DataFrame, docs: DataFrame, id_col: str, text_col: str, num: int, den: int) -> DataFrame:
    """Those of the candidates (a, b, a_rep, b_rep) whose sets are similar."""
    few = _asked(docs.select(id_col, text_col), candidates, id_col)
    text = lambda side: few.select(F.col(id_col).alias(f"{side}_rep"), F.col(text_col).alias(f"{side}_text"))
    rows = candidates.join(text("b"), "b_rep").join(text("a"), "a_rep").select("a", "b", "a_text", "b_text")

    def run(batches):
        for batch in batches:
            for part in chunks([batch], "b_text", 1 << 20, "a_text"):
                sides = []
                for side in ("a", "b"):
                    node = part.column(side).to_numpy()
                    _, index, inverse = np.unique(node, return_index=True, return_inverse=True)
                    sides.append((node, Sets(part.column(f"{side}_text").take(pa.array(index))), inverse))
                (a, sa, ia), (b, sb, ib) = sides
                known = (sa.print[ia] == a) & (sb.print[ib] == b)
                both = _overlaps(sa, ia, sb, ib)
                good = known & (den * both >= num * (sa.n[ia] + sb.n[ib] - both))
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _joined_roots(roots: DataFrame | None, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) after new links: only the components that the links join are worked on."""
    if roots is None:
        return scratch.keep(components(found, scratch))
    if found.isEmpty():
        return roots
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    links = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b")
    moved = components(links, scratch).withColumnsRenamed({"node": "old", "root": "new"})
    before = roots.join(moved, roots["root"] == moved["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    return scratch.keep(before.unionByName(moved.select(F.col("old").alias("node"), F.col("new").alias("root"))).distinct())


def _buckets(survey: DataFrame, each: int = 1 << 21) -> int:
    """As many hash ranges as keep one within a task's memory (some 50 MB), 8 at least."""
    total = survey.where("kind = 0").agg(F.sum("size")).first()[0] or 0
    return max(8, -(-total // each))


def _open(lists: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The postings (key, node, size, room, root, length, top) that still call for comparisons: of members that some room in
    the list can satisfy, in lists of several components, one list of those with the same members. `top` is the longest list
    that the member is in with the same room; a list whose members all have one other list as top has no pair of its own."""
    room, size = F.col("room"), F.col("size")
    want = lambda n: f"{num} * {n}"
    spare = (num + den) * room - num * size  # a partner's size must not exceed spare / num
    bounds = lists.groupBy("key").agg(F.max(spare).alias("most"), F.min("size").alias("small"))
    fit = lists.drop("length", "top").join(bounds, "key").where(f"most >= {want('size')} and {num + den} * room >= {num} * (size + small)").drop("most", "small")
    per = fit.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "room").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("room", "node")).alias("x"), F.min("root").alias("low"), F.max("root").alias("high"))
    one = per.where("low < high").groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", F.col("n").alias("length"))
    left = scratch.keep(fit.join(one, "key"))
    place = left.select("key", "node", "room", "length")
    top = place.groupBy("node", "room").agg(F.max(F.struct("length", "key")).getField("key").alias("top"))
    placed = scratch.keep(place.drop("length").join(top, ["node", "room"]))
    own = placed.groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low < high or low = key").select("key")
    out = scratch.keep(left.join(placed.join(own, "key", "left_semi").select("key", "node", "top"), ["key", "node"]))
    scratch.drop(left, placed)
    return out


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN, most_frequent: int = 1 << 20, least_count: int = 16, buckets: int | None = None) -> DataFrame:
    """A row per text: id, n_shingles, and component_id, the least id reachable by links (None for a null id).
    `buckets`, the hash ranges of the index, follow the number of shingles by default: 2**21 in each."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    survey = scratch.keep(_survey(docs, id_col, text_col))
    members = survey.where("kind = 0").select("doc_id", "size", "node")
    known = survey.where("kind = 0 and size > 0 and doc_id is not null")
    nodes = scratch.keep(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.min("cells").alias("cells"), *[F.min(c).alias(c) for c in BITS]))
    frequent = _frequent(survey, scratch, most_frequent, least_count)
    width = buckets or _buckets(survey)
    found = _postings(docs.where(F.col(id_col).isNotNull()), id_col, text_col, frequent, width).distinct().withColumn("root", F.col("node"))
    lists = _open(found, scratch, num, den)
    active, roots, hubs = scratch.keep(lists.join(nodes.select("node", *BITS), "node")), None, 1
    scratch.drop(lists)
    most = " + ".join([f"bit_count({c} & hub_{c})" for c in BITS[:-1]] + ["least(beyond, hub_beyond)"])  # an overlap's upper bound
    fits = f"node <> hub and root <> hub_root and (top <> hub_top or top = key) and {num + den} * least(room, hub_room, {most}) >= {num} * (size + hub_size)"
    while not active.isEmpty():
        first = roots is None
        sought = active.groupBy("node").agg(F.max_by(F.struct(*[c for c in active.columns if c != "node"]), F.struct("length", "key")).alias("m")).select("node", "m.*") if first else active
        part = F.pmod(F.xxhash64("node"), F.lit(hubs))
        centre = F.min(F.struct((F.col("size") - F.col("room")).alias("own"), "size", "node", "root", "room", "top", *BITS))  # the fewest tokens of its own
        picked = sought.groupBy("key", part.alias("part")).agg(centre.alias("hub")).select("key", *[F.col(f"hub.{c}").alias("hub" if c == "node" else f"hub_{c}") for c in ("node", "root", "size", "room", "top", *BITS)])
        pairs = sought.join(picked, "key").where(fits).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        candidates = scratch.keep(_plausible(pairs, nodes, num, den))
        found = scratch.keep(_verify(candidates, docs, id_col, text_col, num, den))
        roots = _joined_roots(roots, found, scratch)
        rest = active.drop("root")
        if not first:  # the first hubs met only those that chose their list, so they stay
            rest = rest.join(picked.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti")
        old, active = active, _open(rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), scratch, num, den)
        scratch.drop(old, candidates, found)
        scratch.settle()
        hubs *= 1 if first else 8
    roots = roots or scratch.keep(nodes.select("node", F.col("node").alias("root")).limit(0))
    homes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = homes.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = homes.join(least, "root").select("node", "component_id")
    out = members.join(placed, "node", "left")
    home = F.when(F.col("doc_id").isNull() | (F.col("size") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), home.alias("component_id"))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
