"""Texts as byte blocks: word bounds and 64-bit word hashes by numpy, one block of whole texts at a time.

A word is ``[^\\x20\\x09-\\x0D]+``.  These bytes are ASCII, so words can be found in UTF-8 bytes.  Blocks
hold whole texts and about ``BLOCK_BYTES`` bytes, so working memory stays small; only one text longer
than that makes a larger block.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection): every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, U)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever a span lies."""
    return spans_of(prefix_sums(data), starts, ends)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def spans_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(sums))[starts]
    return mix(h + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of a block: byte spans, and ``at[d]:at[d + 1]`` are the words of text d."""

    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


@dataclass
class Block:
    """Texts ``first .. last - 1`` of a batch: their bytes and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def words(self) -> Words:
        inner = ~SPACE[self.data]
        begins, ends = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1]
        ends[:-1] &= ~inner[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inner))]
        begins[edges] |= inner[edges]
        ends[edges - 1] |= inner[edges - 1]
        starts = np.flatnonzero(begins)
        return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets))

    def word_hashes(self, words: Words, lower: bool = True) -> np.ndarray:
        return span_hashes(LOWER[self.data] if lower else self.data, words.starts, words.ends)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    data, at = buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + block_bytes, "right")) - 1)
        yield Block(first, last, data[at[first]:at[last]], at[first:last + 1] - at[first])
        first = last


def doc_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values[at[d]:at[d + 1]]`` for each d, empty ones included."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[at[1:]] - sums[at[:-1]]


def windows(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within one text, and their bounds per text."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    to = np.concatenate([[0], np.cumsum(counts)])
    begin = np.repeat(at[:-1] - to[:-1], counts) + np.arange(to[-1])
    h = np.zeros(to[-1], U)
    for k in range(n):
        h = mix(h * U(0x9E3779B97F4A7C15) + hashes[begin + k])
    return h, to


class Memory:
    """Ids of text spans by their hash, as flat arrays: what a worker process has encoded so far.

    Hashes are kept in two sorted arrays, a large one and a recent one that is merged into it from time to time.
    """

    RECENT = 100_000

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        none = (np.zeros(0, U), np.zeros(0, np.int32))
        self.levels = [none, none]
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.full = 0

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for keys, values in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, values[at], out)
        return out

    def _add(self, level: int, hashes: np.ndarray, places: np.ndarray) -> None:
        keys = np.concatenate([self.levels[level][0], hashes])
        order = np.argsort(keys, kind="stable")
        self.levels[level] = (keys[order], np.concatenate([self.levels[level][1], places.astype(np.int32)])[order])

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append ids; the array doubles when it is full, so that appending stays cheap."""
        need = self.full + len(ids)
        if need > len(self.ids):
            grown = np.zeros(max(need, 2 * len(self.ids)), np.uint32)
            grown[:self.full] = self.ids[:self.full]
            self.ids = grown
        self.ids[self.full:need] = ids
        self.full = need
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])

    def spread(self, hashes: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans one after the other, and the bounds of each span's ids.

        ``learn(first)`` encodes the spans at those positions and returns their flat ids and lengths.
        """
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.at) > self.most:
            self.forget()
        known = self._places(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            ids, lengths = learn(first[new])
            base = len(self.at) - 1
            known[new] = np.arange(base, base + len(new))
            self._keep(ids, lengths)
            self._add(1, distinct[new], known[new])
            if len(self.levels[1][0]) > self.RECENT:
                self._add(0, *self.levels[1])
                self.levels[1] = (np.zeros(0, U), np.zeros(0, np.int32))
        span = known[inverse]
        lengths = self.at[span + 1] - self.at[span]
        to = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.repeat(self.at[span] - to[:-1], lengths) + np.arange(to[-1])], to
