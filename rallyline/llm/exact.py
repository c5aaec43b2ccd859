"""Operator 4: exact dedup by two-pass Bloom filtering.

The first pass marks the bits that at least two hashes of normalised texts hit. In the second, a row whose
bits are not all marked is alone and passes straight through; only the others are shuffled and grouped. Where one
bitmap has no room for all hashes, ranges of them are marked and probed in turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyline.llm import bloom
from rallyline.llm.common import join_counted, map_arrow, map_blocks, text_rows, unused
from rallyline.session import settle

#: Characters that do not count, [\x20\x09-\x0D].
IGNORED = b" \t\n\x0b\x0c\r"


def _digest(text: str | None) -> tuple[bytes, int]:
    return hashlib.sha256((text or "").encode().translate(None, IGNORED)).digest(), len(text or "")


def _head(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, points (code points of the text), sha (of the normalised text), head (64 bits of it), a row each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [_digest(t) for t in batch.column("text").to_pylist()]
        digests = [d for d, _ in pairs]
        return pa.record_batch([batch.column("doc_id"), pa.array([n for _, n in pairs], pa.int64()), pa.array(digests, pa.binary()), pa.array(_head(digests))], ["doc_id", "points", "sha", "head"])

    return map_blocks(text_rows(docs), work, "doc_id long, points long, sha binary, head long")


def _flag(rows: DataFrame, ranges: list[bloom.Range]) -> DataFrame:
    """rows with a boolean maybe: whether the row's hash may occur more than once."""
    schema = T.StructType([*rows.schema, T.StructField("maybe", T.BooleanType())])

    def probed(part: bloom.Range) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(pa.array(part.owns(batch.column("head").to_numpy()))) if part.of > 1 else batch
                maybe = part.holds(own.column("head").to_numpy())
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(maybe)], schema.names)

        return map_arrow(rows, run, schema)

    return bloom.over_ranges(ranges, probed)


def _repeated(heads: DataFrame, count: int) -> Broadcast:
    """A bitmap of the heads that may occur more than once; of many ranges, one of those that do."""
    ranges = bloom.build_ranges(heads, "head", count, least=2)
    if len(ranges) == 1:
        return ranges[0].filled
    several = settle(_flag(heads, ranges).where("maybe").groupBy("head").agg(F.count("*").alias("n")).where("n > 1"))
    return bloom.build(several, "head", several.count(), least=1)


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty and blank texts are one group. Of a group the row with the most code
    points stays, then the smallest doc_id; a null doc_id comes after all others, and of rows alike in both
    any one stays, and only one. No rows give none. Only narrow rows move, never texts; of a group that holds
    many of all rows, no row moves at all.
    """
    rows = settle(fingerprints(docs).withColumn("row", F.monotonically_increasing_id()))
    flagged = _flag(rows, bloom.build_ranges(rows, "head", rows.count(), least=2))
    alone = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    several = flagged.where("maybe").drop("maybe", "head")
    order = F.struct("points", F.coalesce(F.bitwise_not("doc_id"), F.lit(-(1 << 63))).alias("first"), F.bitwise_not("row").alias("row"))
    best = settle(several.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(order).alias("best"), F.max_by("doc_id", order).alias("keep_id")))
    joined = join_counted(several, best, "sha", "group_size").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.bitwise_not(F.col("best.row"))).alias("kept"), "sha"
    )
    return alone.unionByName(joined).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all its columns; rules as in groups().

    A lone row goes straight to the output. Rows that may have copies are first reduced within each batch,
    so of a large group each task sends one row a batch, and then by a window over the hash.
    """
    heads = fingerprints(docs).select("head")
    filled = _repeated(heads, docs.count())
    sha, points, flag, place = unused(docs, "__sha", "__points", "__maybe", "__place")
    marks = T.StructType([*docs.schema, T.StructField(sha, T.BinaryType()), T.StructField(points, T.LongType()), T.StructField(flag, T.BooleanType())])
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_digest(t) for t in batch.column(text_at).to_pylist()]
            maybe = bloom.holds(_head([d for d, _ in pairs]), filled.value) if pairs else np.zeros(0, bool)
            best: dict[bytes, int] = {}
            order = [(-n, i is None, i or 0) for (_, n), i in zip(pairs, batch.column(id_at).to_pylist(), strict=True)]
            for i in np.flatnonzero(maybe).tolist():
                held = best.setdefault(pairs[i][0], i)
                if order[i] < order[held]:
                    best[pairs[i][0]] = i
            stay = np.sort(np.concatenate([np.flatnonzero(~maybe), np.fromiter(best.values(), np.int64, len(best))])).astype(np.int64)
            columns = [pa.array([pairs[i][0] for i in stay], pa.binary()), pa.array([pairs[i][1] for i in stay], pa.int64()), pa.array(maybe[stay])]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(stay)).columns, *columns], marks.names)

    left = map_arrow(docs, run, marks)
    first = Window.partitionBy(sha).orderBy(F.col(points).desc(), F.col("doc_id").asc_nulls_last())
    several = left.where(flag).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return left.where(~F.col(flag)).select(docs.columns).unionByName(several.select(docs.columns))
