"""Cutting texts where no token can cross, and a bounded memo from such units to token ids.

A unit runs from a single space between two visible characters to the next such space. The split
pattern of the vocabularies takes a space only at the start of a match and looks ahead only after
white space, so the ids of a text are those of its units, one after the other. Units are found
and hashed (64 bits) for a whole batch in numpy, and a unit counts as met before only if its bytes
are the same; only others reach Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from .words import same_spans, span_hashes, utf8

#: Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

split = regex.compile(PATTERN).findall

#: Bytes that begin, or end, a character which is certainly not white space: visible ASCII, and two-byte characters after U+00BF.
_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = _OPENS[0xC3:0xE0] = True
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def units(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets at which units begin, ascending."""
    space = np.flatnonzero(data == 0x20)
    space = space[(space >= 1) & (space < len(data) - 1)]
    left = data[space - 1]
    ends = _ASCII[left] | ((left >= 0x80) & (left < 0xC0) & _LEAD[data[np.maximum(space - 2, 0)]])
    space = space[ends & _OPENS[data[space + 1]]]
    begins = np.zeros(len(data), bool)
    begins[space] = begins[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(begins)


class Memo:
    """Token ids by unit. `encode` gets a batch's unseen units and returns their ids end to end and the
    number of ids of each; the memo is emptied when it holds more than `most` units, so that memory
    does not grow with the input."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 800_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        """Forgets all units."""
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending by hash
        self.ids, self.size, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.bytes, self.first, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.known = self.filled = self.held = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a), n - len(a)), a.dtype)])

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encodes units and keeps their ids and bytes; returns their numbers."""
        body = data.tobytes()
        got, sizes = self.encode([body[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())])
        length = end - begin
        n, m, b = self.known + len(sizes), self.filled + len(got), self.held + int(length.sum())
        self.ids, self.bytes = self._room(self.ids, m), self._room(self.bytes, b)
        self.size, self.at, self.first, self.length = (self._room(x, n) for x in (self.size, self.at, self.first, self.length))
        own = slice(self.known, n)
        self.ids[self.filled : m] = got
        self.size[own], self.at[own] = sizes, self.filled + np.cumsum(sizes) - sizes
        self.length[own], self.first[own] = length, self.held + np.cumsum(length) - length
        self.bytes[self.held : b] = data[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        numbers = np.arange(self.known, n)
        self.known, self.filled, self.held = n, m, b
        return numbers

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column end to end, and the n + 1 offsets of the texts in them."""
        if self.known > self.most:
            self.clear()
        data, texts = utf8(column)
        begin = units(data, texts)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        own, index, inverse = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, own)
        number = np.full(len(own), -1)
        near = np.flatnonzero(spot < len(self.hashes))
        near = near[self.hashes[spot[near]] == own[near]]
        number[near] = self.numbers[spot[near]]
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = self._learn(data, begin[index[fresh]], end[index[fresh]])
            self.hashes, self.numbers = np.insert(self.hashes, spot[fresh], own[fresh]), np.insert(self.numbers, spot[fresh], number[fresh])
        place, length = number[inverse], end - begin
        right = self.length[place] == length
        right[right] = same_spans(data, begin[right], self.bytes[: self.held], self.first[place[right]], length[right])
        wrong = np.flatnonzero(~right)  # another unit with this hash
        if len(wrong):
            place[wrong] = self._learn(data, begin[wrong], end[wrong])
        size = self.size[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.at[place] - (ends - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(begin, texts)]
