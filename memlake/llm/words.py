"""Words of whole texts as flat arrays, and hashes of words and word windows.

Texts stay UTF-8 bytes. A chunk of rows is split with a few array passes; a word
is named by a 64-bit polynomial hash of its bytes, a window of words by one of
its word hashes, so equal words and windows have equal names on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute

CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ASCII_SPACE = (9, 10, 11, 12, 13, 32)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the ordered pair of two names."""
    return mix(a * np.uint64(0xD1342543DE82EF95) + mix(b ^ np.uint64(0xA0761D6478BD642F)))


def byte_classes(kind: str) -> np.ndarray:
    """Which bytes are part of a word: all but ASCII white space (`spaced`), or ASCII letters, digits and
    everything beyond ASCII (`alnum`)."""
    table = np.ones(256, bool)
    if kind == "spaced":
        table[list(_ASCII_SPACE)] = False
    elif kind == "alnum":
        table[:128] = False
        for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
            table[ord(low): ord(high) + 1] = True
    else:
        raise ValueError(kind)
    return table


class Words(NamedTuple):
    """All words of a chunk in order; `row` is the row of a word in the chunk, `first` has rows + 1 entries."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def rows(self) -> int:
        return len(self.first) - 1

    def place(self) -> np.ndarray:
        """Position of each word in its own text."""
        return np.arange(len(self.hash)) - self.first[self.row]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive rows with about `size` bytes together, each with its first row; a longer text stands alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


class Splitter:
    """Splits chunks of texts into hashed words; one instance per task keeps the powers of the hash."""

    def __init__(self, kind: str = "spaced", lower: bool = False):
        self.member = byte_classes(kind)
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 1 << 16)
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                values = np.full(n, base, np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values, out=values))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def split(self, texts: pa.Array) -> Words:
        """Words of the rows; null has none."""
        if texts.null_count:
            texts = pa.compute.fill_null(texts, "")
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        if len(texts) == 0:
            bounds = np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0]: bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        data = self.fold[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = self.member[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        before = np.concatenate([[False], inside[:-1]])
        start = np.flatnonzero(inside & (~before | cut))
        end = np.flatnonzero(before & (~inside | cut))
        first = np.searchsorted(start, bounds)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
        sums = self._sums(data.astype(np.uint64) + np.uint64(1))
        name = mix((sums[end] - sums[start]) * self.inverse[start])
        return Words(data, start, end, row, first, name)

    def prefixes(self, words: Words, size: int) -> np.ndarray:
        """Names of the first `size` bytes of each word; never the name of a whole word."""
        sums = self._sums(words.data.astype(np.uint64) + np.uint64(1))
        end = np.minimum(words.start + size, words.end)
        return mix((sums[end] - sums[words.start]) * self.inverse[words.start] + np.uint64(size))

    def spans(self, words: Words, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Names of sequences of words, each with its first word and length."""
        sums = self._sums(words.hash)
        return mix((sums[at + size] - sums[at]) * self.inverse[at] + size.astype(np.uint64))

    def windows(self, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and name of every window of `size` consecutive words of one text."""
        n = len(words.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(words.row[size - 1:] == words.row[:n])
        sums = self._sums(words.hash)
        return at, mix((sums[at + size] - sums[at]) * self.inverse[at] + np.uint64(size))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.diff(np.append(at, len(values)))


def lookup(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values
