"""Exact substring de-duplication with fixed-block anchors.

Every text contributes its non-overlapping blocks of `block` words as references; every
rolling window of `block` words probes them. Since a run of 2 * block - 1 words contains a
whole aligned block wherever it starts, a repeated run of `window` words (2 * block - 1 at
least) always has an anchor. Around the anchors the repeats are extended: all windows of
`window` words that hold an anchor are compared by 64-bit hash, and their union is the
maximal exact repeat. A word goes if such a window also occurs in a text with a smaller id.

How it is dealt: texts are hashed into batches (one shuffle of the texts, read three times).
A batch sends, for each hash range ("bucket"), one sorted array of its distinct probe hashes;
a hash common to a third of all texts is therefore one entry per batch, never a hot group.
A bucket answers each batch with one bit per entry. The windows around anchors take the same
way with the smallest id of the batch. Nothing is collected and no pair of texts is formed.

Ids are integers, as "smaller" means it; others raise. Batches hold some 3 MB of text, more where
the table is so large that pieces (batches times buckets) would be smaller than 1 kB, and buckets
three times a batch's entries and up, so what a task holds follows the bytes of the input. A worker
gives memory back after each batch or bucket, as it lives on beside the next stage's.

Defined results: a null or empty text has no words; a row with a null id is neither compared
nor changed; rows with equal ids never remove each other's words; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .words import U64, Words, covered, give_back, per_doc, small_batches

_PIECES = "batch int, bucket int, body binary"
_KEY = 30
#: Bytes of text in a batch: as a rule, and at most.
BATCH, MOST = 3 << 20, 256 << 20


def _pieces(batch: int, buckets: np.ndarray, body: np.ndarray) -> pa.Table:
    """One row per bucket; `buckets` ascends alongside `body`."""
    at = np.flatnonzero(np.diff(buckets, prepend=-1))
    parts = np.split(body, at[1:]) if len(at) else []
    return pa.table({
        "batch": pa.array([batch] * len(parts), pa.int32()),
        "bucket": pa.array(buckets[at].astype(np.int32), pa.int32()),
        "body": pa.array([p.tobytes() for p in parts], pa.binary()),
    })


class _Batch:
    """The hashes of one batch of texts; rebuilt alike in each of the three reads."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, buckets: int):
        ids = table.column(id_col).cast(pa.int64())
        self.words = Words(table.column(text_col))
        self.known = ~np.asarray(ids.is_null())[self.words.doc]
        self.word_id = pc.fill_null(ids, 0).to_numpy()[self.words.doc]
        self.buckets = buckets

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U64(40)) % U64(self.buckets)).astype(np.int64)

    def anchors(self, block: int):
        """Window starts, the sorted distinct probe keys, each start's place among them, and flags:
        1 if it is an aligned block here, 2 if it occurs in two texts of this batch."""
        starts, h = self.words.windows(block)
        keep = self.known[starts]
        starts, h = starts[keep], h[keep]
        key = (self.bucket(h) << _KEY) | (h & U64((1 << _KEY) - 1)).astype(np.int64)
        keys, place = np.unique(key, return_inverse=True)
        flags = np.zeros(len(keys), np.uint32)
        doc = self.words.doc[starts]
        flags[place[(starts - self.words.first[doc]) % block == 0]] |= 1
        ids = self.word_id[starts]
        least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(least, place, ids)
        np.maximum.at(most, place, ids)
        flags[least < most] |= 2
        return starts, keys, place, flags

    def candidates(self, block: int, window: int, answers: pa.Table):
        """Starts and hashes of the windows that hold an anchor; the distinct hashes in bucket order with their least id."""
        starts, keys, place, _ = self.anchors(block)
        hit = _bits(keys >> _KEY, answers)
        marked = np.zeros(len(self.words) + 1, np.int64)
        marked[starts[hit[place]] + 1] = 1
        sums = np.cumsum(marked)
        begin, h = self.words.windows(window)
        keep = self.known[begin] & (sums[begin + window - block + 1] > sums[begin])
        begin, h = begin[keep], h[keep]
        order = np.lexsort((self.word_id[begin], h, self.bucket(h)))
        begin, h = begin[order], h[order]
        new = np.diff(h, prepend=h[:1] + U64(1)) != 0 if len(h) else np.zeros(0, bool)
        place = np.cumsum(new) - 1
        return begin, place, h[new], self.word_id[begin][new]


def _bits(bucket_of_entry: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The answered bits, entry by entry; the entries ascend by bucket."""
    out = np.zeros(len(bucket_of_entry), bool)
    for bucket, body in zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist()):
        a, b = np.searchsorted(bucket_of_entry, (bucket, bucket + 1))
        out[a:b] = np.unpackbits(np.frombuffer(body, np.uint8), count=b - a).astype(bool)
    return out


def _answer(table: pa.Table, verdict) -> pa.Table:
    """Applies `verdict` to all entries of a bucket at once and packs the bits piece by piece."""
    bodies = table.column("body").to_pylist()
    bits = verdict(bodies)
    packed, at = [], 0
    for n in bits["sizes"]:
        packed.append(np.packbits(bits["hit"][at : at + n]).tobytes())
        at += n
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "body": pa.array(packed, pa.binary())})


def _given(out: pa.Table) -> pa.Table:
    """The result of a step whose own arrays are gone by now."""
    give_back()
    return out


def _repeated_blocks(bodies: list[bytes]) -> dict:
    parts = [np.frombuffer(b, np.uint32) for b in bodies]
    entries = np.concatenate(parts)
    _, place = np.unique(entries >> np.uint32(2), return_inverse=True)
    n = int(place.max()) + 1 if len(place) else 0
    reference = np.bincount(place, entries & 1, n) > 0
    texts = np.bincount(place, 1 + ((entries & 2) > 0), n) > 1
    return {"hit": (reference & texts)[place], "sizes": [len(p) for p in parts]}


def _earlier_windows(bodies: list[bytes]) -> dict:
    """An entry is hit if another batch has the same window under a smaller id."""
    hashes, ids = [], []
    for b in bodies:
        n = len(b) // 16
        hashes.append(np.frombuffer(b, U64, n))
        ids.append(np.frombuffer(b, np.int64, n, 8 * n))
    own = np.concatenate(ids)
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    least = np.full(int(place.max()) + 1 if len(place) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, place, own)
    return {"hit": least[place] < own, "sizes": [len(h) for h in hashes]}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int | None = None, batches: int | None = None, buckets: int | None = None, tidy: bool = True) -> DataFrame:
    """`docs` with the kept words, joined by single spaces, in `text_col`, and two more columns:
    n_words (before) and n_removed. Without `tidy`, a text that loses nothing stays as it is. `block` defaults to the longest that `window` guarantees.

    `batches` and `buckets` follow the bytes of the texts by default; a batch is held in one task's memory.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    block = block or (window + 1) // 2
    if window < 2 * block - 1:
        raise ValueError("window must be at least 2 * block - 1 words")
    clash = {"n_words", "n_removed", "__batch"} & set(docs.columns)
    docs = docs.drop(*clash)
    small_batches(docs.sparkSession)
    if batches is None or buckets is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        each = min(max(BATCH, math.isqrt(1024 * size)), MOST)
        batches, buckets = batches or size // each + 1, buckets or size // (4 * each) + 1
    salt = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.spark_partition_id()))  # rows without an id have no partners
    dealt = docs.withColumn("__batch", F.pmod(F.xxhash64(F.col(id_col), salt, F.lit(7)), F.lit(batches)).cast("int")).repartition(batches, "__batch")
    names = docs.columns

    def probe(table: pa.Table) -> pa.Table:
        b = _Batch(table, id_col, text_col, buckets)
        _, keys, _, flags = b.anchors(block)
        body = ((keys & ((1 << _KEY) - 1)).astype(np.uint32) << np.uint32(2)) | flags
        return _pieces(table.column("__batch")[0].as_py(), keys >> _KEY, body)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _pieces(0, np.zeros(0, np.int64), np.zeros(0, U64))
        b = _Batch(left, id_col, text_col, buckets)
        _, _, h, least = b.candidates(block, window, right)
        bucket = b.bucket(h)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = [x.tobytes() + y.tobytes() for x, y in zip(np.split(h, at[1:]), np.split(least, at[1:]))] if len(at) else []
        return pa.table({"batch": pa.array([left.column("__batch")[0].as_py()] * len(parts), pa.int32()), "bucket": pa.array(bucket[at].astype(np.int32), pa.int32()), "body": pa.array(parts, pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Batch(left, id_col, text_col, buckets)
        stage = right.column("stage").to_numpy()
        first, second = (right.filter(pa.array(stage == k)) for k in (1, 2))
        begin, place, h, least = b.candidates(block, window, first)
        elsewhere = _bits(b.bucket(h), second)
        gone = begin[elsewhere[place] | (b.word_id[begin] > least[place])]
        words = b.words
        removed = covered(gone, window, len(words))
        lost = per_doc(removed, words.first).astype(np.int64)
        texts = pa.array(_joined(words, ~removed), pa.string())
        out = {c: left.column(c) for c in names}
        out[text_col] = texts if tidy else pc.if_else(pa.array(lost > 0), texts, left.column(text_col))
        out["n_words"] = pa.array(words.count.astype(np.int64))
        out["n_removed"] = pa.array(lost)
        return pa.table(out)

    asked = dealt.groupBy("__batch").applyInArrow(lambda t: _given(probe(t)), _PIECES)
    hits = asked.groupBy("bucket").applyInArrow(lambda t: _given(_answer(t, _repeated_blocks)), _PIECES)
    again = dealt.groupBy("__batch").cogroup(hits.groupBy("batch")).applyInArrow(lambda left, right: _given(extend(left, right)), _PIECES)
    earlier = again.groupBy("bucket").applyInArrow(lambda t: _given(_answer(t, _earlier_windows)), _PIECES)
    told = hits.withColumn("stage", F.lit(1)).unionByName(earlier.withColumn("stage", F.lit(2)))
    schema = docs.withColumn(text_col, F.lit(None).cast("string")).withColumn("n_words", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).schema
    return dealt.groupBy("__batch").cogroup(told.groupBy("batch")).applyInArrow(lambda left, right: _given(cut(left, right)), schema)


def _joined(words: Words, keep: np.ndarray) -> list[str]:
    """The kept words of each text with one space between: bytes are gathered for the whole batch."""
    size = np.where(keep, words.end - words.start + 1, 0)
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    kept = np.flatnonzero(keep)
    length = (words.end - words.start)[kept]
    if len(kept):
        run = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to[:-1][kept], length) + run] = words.raw[np.repeat(words.start[kept], length) + run]
    body, bounds = out.tobytes(), to[words.first]
    return [body[a : b - 1].decode() if b > a else "" for a, b in zip(bounds[:-1], bounds[1:])]


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
