"""Word and window hashes of whole texts as numpy arrays, for use inside tasks.

A word's hash is a polynomial in its bytes modulo 2^64, taken from prefix sums over a
block of text; a window's hash is a polynomial in the hashes of its words. No Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20  # texts handled together
CHUNK_BYTES = 1 << 20  # bytes with prefix sums at a time
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
STEP = 0xD6E8FEB86659FD93
OTHER_STEP = 0xA0761D6478BD642F

ASCII_SPACE = [0x20, *range(0x09, 0x0E)]
ASCII_NOT_ALNUM = [b for b in range(0x80) if not chr(b).isalnum()]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins and the last ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, offsets


class Block:
    """Some consecutive texts: their words in one row of arrays.

    ``start`` and ``end`` are byte places in ``data``; ``first[i]`` is the first word
    of text i, and ``first[-1]`` the number of all words."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(separator[data], out=inside[1:-1])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> Iterator[tuple[int, int, int]]:
        """Number in the batch, first word, end of words."""
        for i in range(self.hi - self.lo):
            yield self.lo + i, int(self.first[i]), int(self.first[i + 1])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def window_starts(self, k: int) -> np.ndarray:
        """Words at which a window of k words of one text starts."""
        n = int(self.first[-1])
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        return np.flatnonzero(left >= k)


class WordHasher:
    """Splits texts at separator bytes and hashes the words. Made anew in each task.

    Smaller blocks and chunks take less memory; the hashes are the same."""

    def __init__(self, separators: list[int], lower: bool, block: int = BLOCK_BYTES, chunk: int = CHUNK_BYTES):
        self.block, self.chunk = block, chunk
        self.separator = np.zeros(256, bool)
        self.separator[separators] = True
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[self.fold]
        self._powers(chunk)

    def _powers(self, n: int) -> None:
        inverse = pow(BASE, -1, 1 << 64)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])

    def blocks(self, column: pa.Array) -> Iterator[Block]:
        whole, offsets = text_bytes(column)
        lo = 0
        while lo < len(column):
            hi = int(np.searchsorted(offsets, offsets[lo] + self.block, "right")) - 1
            hi = min(max(hi, lo + 1), len(column))
            yield Block(lo, hi, whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], self.separator)
            lo = hi

    def hashes(self, block: Block) -> np.ndarray:
        """One 64-bit hash for each word of the block."""
        out = np.empty(len(block.start), np.uint64)
        lo = 0
        while lo < len(out):
            base = block.start[lo]
            hi = max(lo + 1, int(np.searchsorted(block.end, base + self.chunk, "right")))
            piece = self.letter[block.data[base : block.end[hi - 1]]]
            if len(piece) >= len(self.power):
                self._powers(len(piece))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * self.power[: len(piece)], out=sums[1:])
            begin, end = block.start[lo:hi] - base, block.end[lo:hi] - base
            out[lo:hi] = (sums[end] - sums[begin]) * self.back[begin]
            lo = hi
        return mix(out)


def windows(word: np.ndarray, k: int, step: int = STEP) -> np.ndarray:
    """Hash of the k words from each word on, by doubling; the last k - 1 have none."""
    word = mix(word, step)
    length, run, out, done = 1, word, None, 0
    while True:
        if k & length:
            if out is None:
                out, done = run, length
            else:
                n = len(word) - done - length + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] * np.uint64(pow(step, length, 1 << 64)) + run[done : done + n]
                done += length
        if done == k:
            return mix(out, step)
        n = len(run) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        run = run[:n] * np.uint64(pow(step, length, 1 << 64)) + run[length : length + n]
        length *= 2


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
