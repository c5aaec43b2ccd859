"""Bitmaps of hashed keys, built in two steps on the executors and bounded in size.

A bit is set where at least `least` keys fell. With least=1 the bitmap is a Bloom filter of the keys; with
least=2 it says which keys may occur more than once. The size of all bitmaps follows the number of keys: beyond
the bound of one, keys are split by hash into ranges with a bitmap each, of which a task holds one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import map_arrow
from rallyline.llm.text import mix

CHUNK = 1 << 16
LARGEST = 1 << 30  # bits: 128 MB to broadcast at most
PER_KEY = 16  # bits: about one lone key in 70 has both its bits hit by others


def bits_for(keys: int) -> int:
    return min(max(CHUNK, 1 << int(keys * PER_KEY - 1).bit_length() if keys else CHUNK), LARGEST)


def ranges_for(keys: int) -> int:
    return max(1, -(-keys * PER_KEY // LARGEST))


def range_of(keys: np.ndarray, of: int) -> np.ndarray:
    """The range of each 64-bit key."""
    return mix(keys.view(np.uint64) ^ np.uint64(0xBB67AE8584CAA73B)) % np.uint64(of)


@dataclass(frozen=True)
class Range:
    """The keys whose range_of is number, and their bitmap, broadcast."""

    number: int
    of: int
    filled: Broadcast

    def owns(self, keys: np.ndarray) -> np.ndarray:
        return range_of(keys, self.of) == self.number if self.of > 1 else np.ones(len(keys), bool)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return holds(keys, self.filled.value)


def slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each 64-bit key."""
    mask = np.uint64(bits - 1)
    first = mix(keys.view(np.uint64))
    return first & mask, mix(first ^ np.uint64(0x6A09E667F3BCC909)) & mask


def build(keys: DataFrame, column: str, count: int, least: int) -> Broadcast:
    """Broadcast (bits, bitmap) of all of a column of longs or arrays of longs; nulls are left out. Above
    LARGEST / PER_KEY keys it lets more others through but loses none."""
    return _build(keys, column, bits_for(count), least, 0, 1)


def build_ranges(keys: DataFrame, column: str, count: int, least: int) -> list[Range]:
    """As many bitmaps as it takes for each to have room for its keys; keys are read once for each."""
    of = ranges_for(count)
    bits = bits_for(-(-count // of))
    return [Range(r, of, _build(keys, column, bits, least, r, of)) for r in range(of)]


def over_ranges(ranges: list[Range], apply: Callable[[Range], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(apply, ranges))


def _build(keys: DataFrame, column: str, bits: int, least: int, number: int, of: int) -> Broadcast:
    """Every task sends, for each chunk of the bitmap, the places that its keys hit, each `least` times at
    most; a task for each chunk counts them as they come, in memory of a chunk's size."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            hit, times = np.unique(np.concatenate(held), return_counts=True)
            hit = np.repeat(hit, np.minimum(times, least))
            chunk = (hit // CHUNK).astype(np.int32)
            cut = np.flatnonzero(np.diff(chunk)) + 1
            parts = [p.astype(np.uint16).tobytes() for p in np.split(hit % CHUNK, cut)]
            held.clear()
            return pa.record_batch([pa.array(chunk[np.concatenate([[0], cut])]), pa.array(parts, pa.binary())], ["chunk", "hits"])

        for batch in batches:
            values = batch.column(0)
            if pa.types.is_list(values.type):
                values = values.flatten()
            found = values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            if of > 1:
                found = found[range_of(found, of) == number]
            if len(found):
                first, second = slots(found, bits)
                held.append(np.concatenate([first, second[second != first]]).astype(np.int64))
            if sum(map(len, held)) > 1 << 18:
                yield flush()
        if held:
            yield flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, np.zeros(CHUNK, np.int64)

        def packed() -> pa.RecordBatch:
            bitmap = np.packbits(times >= least, bitorder="little").tobytes()
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([bitmap], pa.binary())], ["chunk", "bitmap"])

        for batch in batches:
            for chunk, hits in zip(batch.column("chunk").to_pylist(), batch.column("hits"), strict=True):
                if chunk != now:
                    if now is not None:
                        yield packed()
                    now, times[:] = chunk, 0
                times += np.bincount(np.frombuffer(hits.as_buffer(), np.uint16), minlength=CHUNK)
        if now is not None:
            yield packed()

    parts = map_arrow(keys.select(column), places, "chunk int, hits binary")
    merged = map_arrow(parts.repartition("chunk").sortWithinPartitions("chunk"), counted, "chunk int, bitmap binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        bitmap[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast((bits, bitmap))


def holds(keys: np.ndarray, filled: tuple[int, np.ndarray]) -> np.ndarray:
    """Which keys have both their bits set."""
    bits, bitmap = filled
    out = np.ones(len(keys), bool)
    for slot in slots(np.ascontiguousarray(keys), bits):
        out &= (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out
