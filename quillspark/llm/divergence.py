"""How far the sources of a language differ in the terms they use, by single-pass in-memory indexing.

One pass over the texts. A task counts terms in a block of postings (lang, source, term: occurrences
and documents) until the block has filled its share of memory; it is then sorted by term, cut by
hash shard and spilled as one run per shard, into Spark's shuffle, where a lost run is made again.
A task that has all runs of its shards merges them in the order of (lang, term), by a heap over the
keys that end each run's next stretch; runs are merged ahead as soon as they fill the memory share,
so that what is held follows the shard's distinct postings. A language keeps the terms with `least` of its documents or more; their frequencies are
written once. The empty term stands for the group itself, so groups without terms are known too.

With p = 1 + floor(10**9 (count + 5) / (N + 5 V)) of a group or language, a pair of sources differs
by V * |z - z'| for z, z' at count 0, plus corrections at the terms that either has. Those are
streamed: frequencies are dealt by blocks of `TILE` sources and shards of terms, sorted by term, and
each pair of blocks is corrected in one small matrix; the matrices' sums are added up by Spark. So no
task holds a language's sources or terms.

Sums and shares are integers (decimals where 64 bits could not hold them).

Defined results: a null text has no terms, a null lang or source is ''; a language without kept terms
gives its pairs with value 0 and no terms; bytes that are not UTF-8 count as characters of a term;
repeated rows count again; an empty table gives no rows. `id` columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .words import chunks, mix, small_batches, span_hashes, utf8

LEAST, TOP, TILE, SHARDS, SPREAD = 30, 50, 128, 1024, 16
BILLION = 1_000_000_000

_TERM = np.ones(256, bool)
_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEYS = ["lang", "term", "source"]
_POSTINGS = pa.schema([("lang", pa.large_binary()), ("term", pa.large_binary()), ("source", pa.large_binary()), ("count", pa.int64()), ("docs", pa.int64())])


# -- blocks of postings -----------------------------------------------------------------------


def _coded(column) -> tuple[np.ndarray, pa.Array]:
    """Codes and the distinct values that they stand for, nulls as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = pc.fill_null(column.cast(pa.large_binary()), b"").dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def postings(batch, lang: str, source: str, text: str) -> pa.Table:
    """Counts of a batch of texts; a row of the empty term for each group, counting its texts."""
    data, at = utf8(batch.column(text))
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    start, end = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    (l, langs), (s, sources) = _coded(batch.column(lang)), _coded(batch.column(source))
    doc = np.concatenate([np.searchsorted(at, start, "right") - 1, np.arange(batch.num_rows)])
    names = pa.concat_arrays([terms.dictionary, pa.array([b""], pa.large_binary())])
    term = np.concatenate([terms.indices.to_numpy(), np.full(batch.num_rows, len(names) - 1)]).astype(np.int64)
    own, count = np.unique(term * batch.num_rows + doc, return_counts=True)  # a term in a text
    term, doc = own // batch.num_rows, own % batch.num_rows
    group = l.astype(np.int64)[doc] * len(sources) + s[doc]
    own, place = np.unique(term * (len(langs) * len(sources)) + group, return_inverse=True)
    term, group = own // (len(langs) * len(sources)), own % (len(langs) * len(sources))
    total = np.zeros(len(own), np.int64)
    np.add.at(total, place, count)
    columns = [langs.take(pa.array(group // len(sources))), names.take(pa.array(term)), sources.take(pa.array(group % len(sources))), pa.array(total), pa.array(np.bincount(place, minlength=len(own)))]
    return pa.Table.from_arrays(columns, schema=_POSTINGS)


def _ranked(column) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the values, and the distinct values in that order."""
    codes, values = _coded(column)
    order = pc.sort_indices(values).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], values.take(pa.array(order))


def _summed(tables: list[pa.Table]) -> pa.Table:
    """All postings together, one row each, sorted by (lang, term, source)."""
    table = pa.concat_tables(tables)
    if not table.num_rows:
        return table
    (l, langs), (t, terms), (s, sources) = (_ranked(table.column(k)) for k in _KEYS)
    key = (l * len(terms) + t) * len(sources) + s
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count, docs = (np.add.reduceat(table.column(c).to_numpy()[order], first) for c in ("count", "docs"))
    own = order[first]
    return pa.Table.from_arrays([langs.take(pa.array(l[own])), terms.take(pa.array(t[own])), sources.take(pa.array(s[own])), pa.array(count), pa.array(docs)], schema=_POSTINGS)


def blocks(batches, lang: str, source: str, text: str, memory: int) -> Iterator[pa.Table]:
    """Postings of as many texts at a time as stay below `memory` bytes, sorted by (lang, term, source)."""
    parts, size, least = [], 0, 0
    for batch in chunks(batches, text):
        parts.append(postings(batch, lang, source, text))
        size += parts[-1].nbytes
        if size > max(memory, 2 * least):
            parts = [_summed(parts)]
            size = least = parts[0].nbytes
            if size > memory // 2:
                yield parts[0]
                parts, size, least = [], 0, 0
    if parts:
        yield _summed(parts)


def _shards(table: pa.Table, shards: int) -> np.ndarray:
    """The shard of each row by its lang and term."""
    h = np.zeros(table.num_rows, np.uint64)
    for name in ("lang", "term"):
        codes, values = _coded(table.column(name))
        data, at = utf8(values)
        with np.errstate(over="ignore"):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + span_hashes(data, at[:-1], at[1:])[codes])
    return (h % np.uint64(shards)).astype(np.int64)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _POSTINGS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(run: bytes) -> pa.Table:
    return pa.ipc.open_stream(run).read_all()


# -- merging runs -----------------------------------------------------------------------------


def _key(table: pa.Table, i: int) -> tuple[bytes, bytes]:
    return table.column("lang")[i].as_py(), table.column("term")[i].as_py()


def _after(table: pa.Table, at: int, key: tuple[bytes, bytes]) -> int:
    """The first row from `at` on whose (lang, term) is beyond `key`."""
    return bisect.bisect_right(range(table.num_rows), key, lo=at, key=lambda i: _key(table, i))


def merge(runs: list[pa.Table], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted runs as one, in tables of whole terms: a heap has the key that ends the next `rows` rows of each run; up to the
    least of these all runs are read together."""
    at = [0] * len(runs)
    heap = [(_key(run, rows - 1), k) for k, run in enumerate(runs) if run.num_rows > rows]
    heapq.heapify(heap)
    while True:
        parts, bound = [], heap[0][0] if heap else None
        for k, run in enumerate(runs):
            end = run.num_rows if bound is None else _after(run, at[k], bound)
            if end > at[k]:
                parts.append(run.slice(at[k], end - at[k]))
                at[k] = end
        if parts:
            yield _summed(parts)
        if bound is None:
            return
        while heap and heap[0][0] <= bound:
            _, k = heapq.heappop(heap)
            if runs[k].num_rows - at[k] > rows:
                heapq.heappush(heap, (_key(runs[k], at[k] + rows - 1), k))


def frequencies(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, memory: int = 48 << 20) -> DataFrame:
    """(lang, term, source, count, total) of the terms that `least` texts of their language have, total being the language's count;
    the empty term has a row for each (lang, source), with its number of texts."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))

    def index(batches):
        for block in blocks(batches, "lang", "source", "text", memory):
            shard = _shards(block, SHARDS)
            order = np.argsort(shard, kind="stable")
            block, shard = block.take(pa.array(order)), shard[order]
            bounds = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(bounds, bounds[1:]):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([shard[a]], pa.int32()), pa.array([_pack(block.slice(a, b - a))], pa.binary())], names=["shard", "run"])

    def join(batches):
        held, size, limit = [], 0, memory // 4
        for batch in batches:
            for run in batch.column("run").to_pylist():
                held.append(_unpack(run))
                size += held[-1].nbytes
                if size > limit:
                    held = [pa.concat_tables(merge(held))]
                    size = held[0].nbytes
                    limit = max(memory // 4, 2 * size)  # grows with the distinct postings only
        for table in merge(held):
            (l, _), (t, terms) = _coded(table.column("lang")), _coded(table.column("term"))
            first = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (t[1:] != t[:-1])]))
            times = np.diff(np.append(first, len(l)))
            enough = np.add.reduceat(table.column("docs").to_numpy(), first) >= least
            enough |= pc.equal(terms, b"").to_numpy(zero_copy_only=False)[t[first]]
            total = np.repeat(np.add.reduceat(table.column("count").to_numpy(), first), times)
            table = table.append_column("total", pa.array(total)).filter(pa.array(np.repeat(enough, times)))
            strings = [table.column(c).combine_chunks().cast(pa.binary()).view(pa.string()) for c in ("lang", "term", "source")]
            yield pa.RecordBatch.from_arrays([*strings, *(table.column(c).combine_chunks() for c in ("count", "total"))], names=["lang", "term", "source", "count", "total"])

    runs = docs.mapInArrow(index, "shard int, run binary").repartition("shard")
    return runs.mapInArrow(join, "lang string, term string, source string, count long, total long")


# -- shares and their differences -------------------------------------------------------------


def _share(count: str, n: str):
    """p of a count, exact: a quotient of decimals, a billion and one at most."""
    return F.expr(f"((cast({count} AS decimal(20,0)) + 5) * cast({BILLION} AS decimal(10,0))) div (cast({n} AS decimal(20,0)) + 5 * cast(v AS decimal(20,0))) + 1")


def _difference(zero: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """|z - z'| of all pairs of two blocks, and as many zeros."""
    base = np.abs(np.array(zero[0], np.int64)[:, None] - np.array(zero[1], np.int64))
    return base, np.zeros_like(base)


def _tiles(batches) -> Iterator[pa.RecordBatch]:
    """Sums of |p - p'| over the terms of each (lang, bi, bj, part), which come together, the sources' own rows (empty term) first."""
    key, last, names, zero, base, total, rows = None, None, [], [], None, None, []

    def flush():
        if not rows:
            return
        at, number, p = np.array(rows, np.int64).T
        at -= at[0]
        sides = []
        for block, z in zip(key[1:3], zero):
            side, own = np.tile(z, (at[-1] + 1, 1)), number // TILE == block
            side[at[own], number[own] % TILE] = p[own]
            sides.append(side)
        for k in range(len(names[0])):
            total[k] += np.abs(sides[0][:, k, None] - sides[1]).sum(0) - base[k] * (at[-1] + 1)
        rows.clear()

    def done():
        nonlocal base, total
        if base is None:
            base, total = _difference(zero)
        flush()
        _, first, second, part, v = key
        sums = total + base * v if part == 0 else total
        out = [(x, y, int(sums[i, j])) for i, a in enumerate(names[0]) for j, b in enumerate(names[1]) if first < second or i < j for x, y in ((a, b), (b, a))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out)), *(pa.array(c) for c in zip(*out))], names=["lang", "source", "item", "value"])

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("lang", "bi", "bj", "part", "v", "term", "number", "source", "p")]
        for *own, term, number, source, p in zip(*columns):
            if own != key:
                if key:
                    yield from done()
                key, last, at, names, zero, base = own, "", 0, [[], []], [[], []], None
            if term == "":  # in the order of the numbers, which have no gaps
                for k in (0, 1):
                    if number // TILE == key[1 + k]:
                        names[k].append(source)
                        zero[k].append(p)
                continue
            if base is None:
                base, total = _difference(zero)
            if term != last:
                last, at = term, at + 1
                if len(rows) >= 8_000:
                    flush()
            rows.append((at, number, p))
    if key:
        yield from done()


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each other source of the language (part pair), and the terms the group uses more than its language (part term)."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(frequencies(docs, lang, source, text, least))
    used = found.where("term <> ''")
    groups = found.where("term = ''").select("lang", "source")
    sizes = groups.join(used.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    terms = used.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sizes = sizes.join(terms, "lang", "left").select("lang", "source", number.alias("number"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "lang_n")])
    sizes = scratch.keep(sizes)  # a row per (lang, source)
    few = sizes.count() <= 100_000
    known = used.join(F.broadcast(sizes) if few else sizes, ["lang", "source"])  # beyond that, Spark shuffles both sides
    known = known.withColumn("p", _share("count", "n"))
    zero = F.when(F.col("v") > 0, _share("0", "n")).otherwise(0)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = known.withColumn("value", F.col("p") - _share("total", "lang_n")).where("value > 0")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    counts = sizes.groupBy("lang").agg(F.floor(F.max("number") / TILE).alias("last"))
    block = F.floor(F.col("number") / TILE)
    part = F.pmod(F.xxhash64("term"), F.lit(SPREAD)).cast("int")
    columns = ["lang", "v", "number", "p", "last"]
    marks = sizes.withColumn("p", zero).join(counts, "lang").select(*columns, F.lit("").alias("term"), "source", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    rows = known.join(F.broadcast(counts) if few else counts, "lang").select(*columns, "term", F.lit("").alias("source"), part.alias("part"))
    dealt = marks.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    dealt = dealt.select("lang", "v", "number", "p", "term", "source", "part", F.least(block, "other").alias("bi"), F.greatest(block, "other").alias("bj"))
    dealt = dealt.repartition("lang", "bi", "bj", "part").sortWithinPartitions("lang", "bi", "bj", "part", "term", "number")
    sums = dealt.mapInArrow(_tiles, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(over)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


ORACLE_SQL = {
    "op12_source_divergence": r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT lang, source, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
used AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(c) AS n FROM used GROUP BY lang, source),
g AS (SELECT d.lang, d.source, coalesce(o.n, 0) AS n, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN own o USING (lang, source) LEFT JOIN sums s ON s.lang = d.lang),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c, 1 + (1000000000 * (coalesce(u.c, 0) + 5)::HUGEINT) // (g.n + 5 * g.v) AS p, 1 + (1000000000 * (k.total + 5)::HUGEINT) // (s.n + 5 * s.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN sums s ON s.lang = g.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT r.lang, r.source, t.source AS item, sum(abs(r.p - t.p)) AS value FROM grid r JOIN grid t ON r.lang = t.lang AND r.term = t.term AND r.source <> t.source GROUP BY 1, 2, 3) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM grid WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
}
