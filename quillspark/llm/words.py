"""Vectorised word, line and shingle hashing over Arrow text columns.

Texts are handled as UTF-8 bytes in numpy; words are maximal runs of bytes outside
{0x20, 0x09..0x0D}. A span's hash takes its bytes eight at a time, each step scrambled with a
key of its place, for all spans of a batch at once, so no Python object is made per word; spans
beyond `_LONG` bytes are hashed by keyed BLAKE2b. A null text reads as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import DataType

U64 = np.uint64
_KEY = 0xD6E8FEB86659FD93
_LONG = 1024
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)  # masks of the lowest k bytes
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xBEA225F9EB34556D)
    x ^= x >> U64(29)
    x *= U64(0xBEA225F9EB34556D)
    x ^= x >> U64(32)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n + 1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    body = a.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def with_field(schema, *fields: tuple[str, str]):
    """A copy of a Spark schema with more fields, given as name and type."""
    out = type(schema)(list(schema.fields))
    for name, kind in fields:
        out = out.add(name, DataType.fromDDL(kind))
    return out


def small_batches(spark, rows: int = 1000) -> None:
    """Texts reach the workers in Arrow batches of `rows`, where the session still has Spark's default of 10,000:
    a batch is held on both sides at once, and texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def give_back() -> None:
    """Returns memory that this worker holds but does not use to the system, where its allocator can; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches, text: str, size: int = 1 << 20, other: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in record batches of at most about `size` bytes of text (and of a second text column), at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(text))
        if other:
            at = at + utf8(batch.column(other))[1]
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte span [start, end)."""
    size, at = end - start, eights(data)
    with np.errstate(over="ignore"):
        h = mix(size.astype(U64) + U64(_KEY)) ^ (at[start] & _LOW[np.minimum(size, 8)])
        h = mix(h * U64(0x9E3779B97F4A7C15))
        more, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(more):
            own, key = h[more], U64(_KEY * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)
            own ^= at[start[more] + k] & _LOW[np.minimum(size[more] - k, 8)]
            h[more] = mix(own * U64(0x9E3779B97F4A7C15) + key)
            k += 8
            more = more[size[more] > k]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        h[long] = [int.from_bytes(hashlib.blake2b(view[a:b], digest_size=8, key=b"spans").digest(), "little") for a, b in zip(start[long].tolist(), end[long].tolist())]
    return h


def same_spans(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of one length, in two arrays of bytes, hold the same bytes."""
    a, b = eights(data), eights(other)
    out = ((a[start] ^ b[other_start]) & _LOW[np.minimum(size, 8)]) == 0
    more, k = np.flatnonzero((size > 8) & out), 8
    while len(more) > 64:
        good = ((a[start[more] + k] ^ b[other_start[more] + k]) & _LOW[np.minimum(size[more] - k, 8)]) == 0
        out[more[~good]] = False
        k += 8
        more = more[good & (size[more] > k)]
    for i in more.tolist():  # a few long ones: whole arrays at once
        x, y, n = int(start[i]), int(other_start[i]), int(size[i])
        out[i] = bool((data[x : x + n] == other[y : y + n]).all())
    return out


def hash_strings(strings) -> np.ndarray:
    """The span hash of each string."""
    raw = [x.encode() if isinstance(x, str) else x for x in strings]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(size)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - size, end)


class Words:
    """Words of a batch of texts: byte spans, hashes, and the word offsets of each text."""

    def __init__(self, column, lower: bool = False, hashed: bool = True):
        self.raw, self.at = utf8(column)
        data = self.raw
        self.plain = _LOWER[data] if lower else data
        inside = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.at] = True
        if len(data):
            before, after = np.empty_like(inside), np.empty_like(inside)
            before[0] = after[-1] = False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            self.start = np.flatnonzero(inside & (~before | edge[:-1]))
            self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        if hashed:
            self.hash = span_hashes(self.plain, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as word numbers) and hashes of every window of k words inside one text."""
        m = len(self) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        with np.errstate(over="ignore"):
            h = np.zeros(m, U64)
            for j in range(k):
                h = h * U64(0xA24BAED4963EE407) + self.hash[j : j + m]
            h = mix(h + U64(k))
        starts = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return starts, h[starts]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words beginning at one of `starts`."""
    turn = np.bincount(starts, minlength=n + k + 1)
    return np.cumsum(turn - np.concatenate([np.zeros(k, turn.dtype), turn[:-k]]))[:n] > 0


def per_doc(mask_or_values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a per-word array over each text."""
    total = np.concatenate([[0], np.cumsum(mask_or_values)])
    return total[first[1:]] - total[first[:-1]]
