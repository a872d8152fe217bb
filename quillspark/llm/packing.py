"""Hierarchical packing of documents into sequences of several lengths.

A document of the longest tier's size or more gives full windows of that size; the rest of it,
or a whole shorter document, is routed to the smallest tier that holds it. The longest tier is
packed first: each of its windows starts with one of its own pieces, and the gap is filled with
the largest pieces of shorter tiers that fit, the last of them cut at the window's end. What
the shorter tiers still hold then fills windows of their own sizes in the same way. So only the
last window of a task can have a gap. Windows of one tier are dealt into step groups of equal
token counts, in order of their attention cost (the sum of squared piece lengths) and back, so
that the groups' costs balance.

It is one narrow pass: no shuffle, a task holds the pieces of a few megabytes of text, and ids
of sequences are made of the partition's number and a counter, so a retried task repeats them.
Rows must come in a fixed order within a partition for that (a scan, or a written table).

A special token of the vocabulary that stands in a text is that token, as the library's own call
has it. Defined results: a null or empty text is the end token alone; a null id stays null; rows with
equal ids are packed as separate documents; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .pretokens import Memo
from .words import chunks, give_back, small_batches

TIERS = (256, 512, 1024)
STEP_TOKENS = 8192
END = 0
_MEMOS: dict[int, Memo] = {}


def _encoder(vocabulary: str):
    """The memo of this worker for a tokenizer file's contents."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _MEMOS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only hold memory of their own
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary)
        _MEMOS[key] = Memo(lambda unseen: _encode(t, unseen))
    return _MEMOS[key]


def _encode(t, unseen: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and how many each has. Units without inner white space and special tokens are
    joined by line feeds, which no token crosses, as a call for a few characters spends its time outside the merges."""
    (feed,) = t.encode("\n", add_special_tokens=False).ids
    special = [a.content for a in t.get_added_tokens_decoder().values()]
    plain = np.fromiter((len(u) < 64 and u[:2] != "  " and u.split() == [u.lstrip(" ")] and not any(s in u for s in special) for u in unseen), bool, len(unseen))
    some = [u for u, p in zip(unseen, plain) if p]
    groups = ["\n".join(some[a : a + together]) + "\n" for a in range(0, len(some), together)]
    joined = np.fromiter(chain.from_iterable(e.ids for e in t.encode_batch_fast(groups, add_special_tokens=False)), np.uint32)
    feeds = np.flatnonzero(joined == feed)
    sizes = np.zeros(len(unseen), np.int64)
    sizes[plain] = np.diff(feeds, prepend=-1) - 1
    rest = [e.ids for e in t.encode_batch_fast([u for u, p in zip(unseen, plain) if not p], add_special_tokens=False)]
    sizes[~plain] = [len(x) for x in rest]
    of_plain = np.repeat(plain, sizes)
    ids = np.empty(len(of_plain), np.uint32)
    ids[of_plain] = joined[joined != feed]
    ids[~of_plain] = np.fromiter(chain.from_iterable(rest), np.uint32)
    return ids, sizes


class _Pool:
    """Pieces by length: a piece is (row, start, ids)."""

    def __init__(self):
        self.by_size: dict[int, list] = {}
        self.sizes = 0  # a bit for each length there is
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by_size.setdefault(n, []).append(piece)
        self.sizes |= 1 << n
        self.tokens += n

    def take(self, most: int) -> tuple | None:
        """The longest piece of at most `most` tokens."""
        n = (self.sizes & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < 1:
            return None
        found = self.by_size[n]
        piece = found.pop()
        if not found:
            self.sizes &= ~(1 << n)
        self.tokens -= n
        return piece

    def least(self) -> tuple | None:
        return self.take((self.sizes & -self.sizes).bit_length() - 1) if self.sizes else None


class Packer:
    """Packs the pieces it is given; `take` returns the windows that are full."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.pools = {t: _Pool() for t in self.tiers}
        self.full: list[tuple[int, list]] = []
        self.waiting = {t: [] for t in self.tiers}
        self.steps = 0

    def route(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def add(self, row, ids: np.ndarray) -> None:
        top = self.tiers[-1]
        whole = len(ids) // top * top
        for at in range(0, whole, top):
            self.full.append((top, [(row, at, ids[at : at + top])]))
        if whole < len(ids):
            self.pools[self.route(len(ids) - whole)].add((row, whole, ids[whole:]))

    def _fill(self, window: list, gap: int, tier: int) -> int:
        """Fills the gap from this tier and shorter ones; returns what is left of it."""
        below = [t for t in reversed(self.tiers) if t <= tier]
        while gap:
            for t in below:
                if piece := self.pools[t].take(gap):
                    break
            else:
                for t in reversed(below):  # nothing fits whole: cut the shortest
                    if piece := self.pools[t].least():
                        row, at, ids = piece
                        rest = (row, at + gap, ids[gap:])
                        self.pools[self.route(len(rest[2]))].add(rest)
                        piece = (row, at, ids[:gap])
                        break
                else:
                    return gap
            window.append(piece)
            gap -= len(piece[2])
        return 0

    def pack(self, last: bool = False) -> None:
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            while pool.sizes and (sum(self.pools[t].tokens for t in self.tiers if t <= tier) >= tier):
                window: list = []
                self._fill(window, tier, tier)
                self.full.append((tier, window))
        if last:
            top, window = self.tiers[-1], []
            self._fill(window, top, top)
            if window:
                self.full.append((top, window))

    def take(self, last: bool = False) -> list[tuple[int, int, list]]:
        """(tier, step group, window) of every window whose group is complete."""
        self.pack(last)
        for tier, window in self.full:
            self.waiting[tier].append(window)
        self.full, out = [], []
        for tier, windows in self.waiting.items():
            size = max(1, self.step_tokens // tier)
            ready = len(windows) if last else len(windows) // size * size
            groups = -(-ready // size)
            some = sorted(windows[:ready], key=lambda w: -sum(len(p[2]) ** 2 for p in w))
            for k, window in enumerate(some):
                turn, place = divmod(k, groups)
                out.append((tier, self.steps + (place if turn % 2 == 0 else groups - 1 - place), window))
            self.steps += groups
            self.waiting[tier] = windows[ready:]
        return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row for each piece: its document, start and length there, its sequence and offset there, the
    sequence's tier and step group, and, if `with_ids`, the token ids. `vocabulary` is the path of a
    tokenizer file on the driver; its contents, of bounded size, are broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"

    def run(batches):
        encode, packer = _encoder(shared.value), Packer(tiers, step_tokens)
        base, made, id_type = TaskContext.get().partitionId() << 40, 0, None

        def rows(windows) -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in range(10)]
            for tier, step, window in windows:
                offset = 0
                for (doc, total), at, ids in window:
                    for c, v in zip(cols, (doc, at, len(ids), zlib.crc32(ids.tobytes()), total, base + made, offset, tier, base + step, ids)):
                        c.append(v)
                    offset += len(ids)
                made += 1
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.int64())]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
            if with_ids:
                arrays.append(pa.array([i.astype(np.int32) for i in cols[9]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in chunks(batches, text_col):
            id_type = batch.column(id_col).type
            ids, at = encode(batch.column(text_col))
            for doc, a, b in zip(batch.column(id_col).to_pylist(), at[:-1], at[1:]):
                own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                packer.add((doc, len(own)), own)
            if windows := packer.take():
                yield rows(windows)
        if id_type is not None:
            yield rows(packer.take(last=True))
        encode.clear()
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, schema + ", ids array<int>" * with_ids)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
