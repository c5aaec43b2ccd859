"""Texts of an Arrow batch as one byte array: words, lines and their hashes by array operations.

Nothing here loops over words. A stretch of up to 16 bytes is hashed by a permutation of 128 bits, so no two of them
share a hash; one of up to 32 goes through the permutation twice, and a longer one through BLAKE2b.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROUNDS = np.arange(1, 5, dtype=np.uint64) * _ODD
STEP = 16  # bytes that go through the permutation at a time
#: By how many of eight bytes belong to a stretch, the others set: 0xFF is in no UTF-8 text, so lengths tell apart.
_FILL = np.array([((1 << 64) - 1) >> 8 * k << 8 * k for k in range(8)] + [0], np.uint64)

#: The white space of the word contracts, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over 64 bits (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _permuted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of pairs of 64 bits: four Feistel rounds."""
    for one, two in _ROUNDS.reshape(2, 2):
        second = second ^ mix(first + one)
        first = first ^ mix(second + two)
    return first, second


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most limit text bytes, or of a single longer row."""
    offsets = _offsets(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


class Block:
    """The texts of one string column; null counts as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if column.null_count:
            column = column.fill_null("")
        if not len(column):
            column = pa.array([], pa.string())
        offsets = _offsets(column) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2] if len(column) else None
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.raw = raw[offsets[0] : offsets[-1]]
        self.at = offsets - offsets[0]
        self.n = len(column)
        self._bytes = np.full(len(self.raw) + 2 * STEP, 255, np.uint8)  # room to read whole steps beyond the end
        self._bytes[: len(self.raw)] = _LOWER[self.raw] if lower else self.raw
        self.in_word = ~SPACE[self.raw]
        self.begin, self.end, self.doc = self.runs(self.in_word)
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text of every longest run of flagged bytes within a text."""
        begins, ends = flags.copy(), flags.copy()
        begins[1:] &= ~flags[:-1]
        ends[:-1] &= ~flags[1:]
        heads = self.at[:-1][self.at[:-1] < self.at[1:]]  # of texts that have bytes
        tails = self.at[1:][self.at[:-1] < self.at[1:]] - 1
        begins[heads], ends[tails] = flags[heads], flags[tails]
        begin = np.flatnonzero(begins)
        return begin, np.flatnonzero(ends) + 1, np.searchsorted(self.at, begin, "right") - 1

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two columns of 64 bits for each stretch from begin to end."""
        size = end - begin
        out = np.zeros((2, len(size)), np.uint64)
        eights = np.ndarray(len(self._bytes) - 7, "<u8", self._bytes, strides=(1,))  # the eight bytes from every place on
        for low, high in ((-1, STEP), (STEP, 2 * STEP)):
            some = np.flatnonzero((size > low) & (size <= high))
            state = np.zeros((2, len(some)), np.uint64)
            for at in range(0, high, STEP):
                words = [eights[begin[some] + at + k] | _FILL[np.clip(size[some] - at - k, 0, 8)] for k in (0, 8)]
                state = _permuted(state[0] ^ words[0], state[1] ^ words[1])
            out[:, some] = state
        some = np.flatnonzero(size > 2 * STEP)
        data = memoryview(self._bytes)
        digests = [blake2b(data[a:b], digest_size=16).digest() for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
        out[:, some] = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2).T
        return out.T

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.begin, self.end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def windows(self, k: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k words in a row of one text, and the index of each window's first word."""
        if len(words) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.doc[: len(words) - k + 1] == self.doc[k - 1 :])
        total = np.zeros(len(first), np.uint64)
        for i in range(k):
            total = mix(total * _ODD + words[first + i])
        return total, first

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text of every newline-split line."""
        breaks = np.flatnonzero(self.raw == 0x0A)
        begin = np.sort(np.concatenate([self.at[:-1], breaks + 1]))
        # a break that is a text's last byte leaves an empty line at the place where the next text begins
        owner = np.sort(np.concatenate([np.arange(self.n), np.searchsorted(self.at, breaks, "right") - 1]))
        end = np.sort(np.concatenate([breaks, self.at[1:]]))
        return begin, end, owner


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out
