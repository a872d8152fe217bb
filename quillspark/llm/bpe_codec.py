"""Byte-level BPE with two tiers of lookup.

Whole pre-tokens that are in the vocabulary are resolved by a minimal perfect hash, for all the
distinct pre-tokens of a batch at once; the others are merged with a heap of candidate pairs
over a linked list of their bytes, in O(n log n) for n bytes. Both are exact: a slot's key is
compared with the pre-token. The tables are built once on the driver and broadcast; their size
is the vocabulary's. One narrow pass; a worker's memo of pre-tokens is bounded.

Defined results: a null text encodes as an empty one, to no ids; rows are independent of each
other, so repeated rows, ties and other columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import Memo, split
from .words import U64, chunks, mix, small_batches, span_hashes, with_field


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's vocabulary: a line holds a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def hash_keys(keys: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    end = np.cumsum(size)
    return span_hashes(np.frombuffer(b"".join(keys), np.uint8), end - size, end)


@dataclass
class PerfectHash:
    """Hash and displace: a bucket's displacement sends each of its keys to a slot of its own, with as many slots as keys."""

    shift: np.ndarray
    keys: list[bytes]
    value: np.ndarray

    @staticmethod
    def _slot(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h + shift.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)

    @classmethod
    def build(cls, vocabulary: dict[bytes, int], per_bucket: int = 3) -> PerfectHash:
        keys, n = list(vocabulary), len(vocabulary)
        h = hash_keys(keys)
        if len(np.unique(h)) < n:
            raise ValueError("two keys have one hash")
        buckets = max(1, n // per_bucket)
        bucket = (h % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(buckets + 1))
        shift, taken, slot_of = np.zeros(buckets, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        sizes = np.diff(first)
        tries = np.arange(256)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[first[b] : first[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                slots = cls._slot(h[own][None, :], (tries + base)[:, None], n)
                s = np.sort(slots, 1)
                good = ~taken[slots].any(1) & (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    d = int(np.argmax(good))
                    break
                base += len(tries)
            shift[b] = base + d
            slot_of[own] = slots[d]
            taken[slots[d]] = True
        alone = np.flatnonzero(sizes == 1)  # a bucket of one key names a free slot itself
        free = np.flatnonzero(~taken)
        shift[alone] = -1 - free[: len(alone)]
        slot_of[order[first[alone]]] = free[: len(alone)]
        at = np.argsort(slot_of)
        return cls(shift, [keys[i] for i in at], np.fromiter((vocabulary[keys[i]] for i in at), np.int64, n))

    def find(self, asked: list[bytes]) -> list[int | None]:
        h = hash_keys(asked)
        shift = self.shift[(h % U64(len(self.shift))).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slot(h, shift, len(self.keys)))
        return [v if self.keys[s] == key else None for key, s, v in zip(asked, slot.tolist(), self.value[slot].tolist())]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Repeatedly joins the neighbours of the lowest rank, the leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # a symbol's end, at its first byte; 0 once it has been joined to its left
    before = list(range(-1, n))
    heap = [r << 52 | i << 26 | i + 2 for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    low = (1 << 26) - 1
    while heap:
        x = heappop(heap)
        i, e = x >> 26 & low, x & low
        j = end[i]
        if not 0 < j < e or end[j] != e:
            continue
        end[i], end[j] = e, 0
        p = before[i]
        if p >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heappush(heap, r << 52 | p << 26 | e)
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heappush(heap, r << 52 | i << 26 | end[e])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash):
        self.ranks, self.perfect = ranks, perfect
        self.memo, self.found = Memo(self._encode), {}
        tokens = {r: t for t, r in ranks.items()}
        size = np.zeros(max(tokens) + 1, np.int64)
        for r, t in tokens.items():
            size[r] = len(t)
        self.size, self.at = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(tokens.get(r, b"") for r in range(len(size))), np.uint8)

    def _encode(self, unseen: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [split(u) for u in unseen]
        found = self.found
        if len(found) > 500_000:
            found.clear()
        if new := [p for p in {p for part in parts for p in part} if p not in found]:
            pieces = [p.encode() for p in new]
            found.update((p, merge(x, self.ranks) if v is None else (v,)) for p, x, v in zip(new, pieces, self.perfect.find(pieces)))
        ids = [found[p[0]] if len(p) == 1 else [i for q in p for i in found[q]] for p in parts]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        return self.memo(column)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts end to end and the texts' offsets in them."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        body = self.bytes[np.repeat(self.at[ids] - (ends - size), size) + np.arange(total)]
        return body.tobytes(), np.concatenate([[0], ends])[at]


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    name, ranks, perfect = shared.value
    if name not in _CODECS:
        _CODECS[name] = Codec(ranks, perfect)
    return _CODECS[name]


def _share(spark, path: str):
    small_batches(spark)
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((hashlib.sha256(Path(path).read_bytes()).hexdigest(), ranks, PerfectHash.build(ranks)))


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with the token ids of each text; a column of that name is replaced."""
    docs = docs.drop(ids_col)
    shared, schema = _share(docs.sparkSession, ranks_path), with_field(docs.schema, (ids_col, "array<int>"))

    def run(batches):
        for batch in chunks(batches, text_col):
            ids, at = _codec(shared).encode(batch.column(text_col))
            yield batch.append_column(ids_col, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """`encoded` with the bytes that the ids stand for; null ids give no bytes."""
    encoded = encoded.drop(bytes_col)
    shared, schema = _share(encoded.sparkSession, ranks_path), with_field(encoded.schema, (bytes_col, "binary"))

    def run(batches):
        for batch in batches:
            lists = [np.asarray(x or [], np.int64) for x in batch.column(ids_col).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            body, bounds = _codec(shared).decode(np.concatenate([*lists, np.zeros(0, np.int64)]), at)
            yield batch.append_column(bytes_col, pa.array([body[a:b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()))

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the bytes decoded from them, in one pass."""
    shared = _share(docs.sparkSession, ranks_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, text_col):
            codec = _codec(shared)
            ids, at = codec.encode(batch.column(text_col))
            body, bounds = codec.decode(ids, at)
            raw = memoryview(ids.astype("<u4").tobytes())
            view = memoryview(body)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])]),
                    pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
