"""Shared plumbing of the operators: reading text columns, passing rows through Arrow, hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyline.llm.text import slices
from rallyline.session import ship_package, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_rows(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and the named columns only; whatever else docs carries, under any name, is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes not to be a column of docs."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Hand freed memory back to the system: Arrow and the C library keep it for a process that lives on to other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What a worker process keeps between tasks: by the operator it is for, how to drop it.
KEPT: dict[str, Callable[[], object]] = {}


def _keep_only(owner: str) -> None:
    """Of what this worker process keeps, drop what is not the operator's own."""
    for other, drop in KEPT.items():
        if other != owner:
            drop()


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: str = "") -> DataFrame:
    """rows.mapInArrow(run), with the memory of each task given back at its end, and with nothing held in the worker
    that another operator kept there."""
    ship_package(rows.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_only(keeps)
        yield from run(batches)
        give_back()

    return rows.mapInArrow(tidy, schema)


class Recent:
    """A table of answers of bounded size that keeps what was asked lately: two generations of at most `most` entries
    and what one block of texts adds."""

    def __init__(self, most: int):
        self.most = most
        self.now: dict = {}
        self.older: dict = {}

    def turn(self) -> None:
        """To be called before each block: a full generation becomes the older one."""
        if len(self.now) > self.most:
            self.older, self.now = self.now, {}

    def missing(self, keys: set) -> set:
        """Those of the keys that have no answer; answers of the older generation become current again."""
        new, older = keys.difference(self.now), self.older
        back = older.keys() & new
        self.now.update(zip(back, map(older.__getitem__, back), strict=True))
        return new - back


def map_blocks(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str, keeps: str = "") -> DataFrame:
    """Apply work to runs of rows of about a megabyte of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield work(part)

    return map_arrow(rows, run, schema, keeps)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, hot: int = 2000, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key; count says how many rows each key has).

    Keys with more than one row in `hot` can number at most `hot`, so those groups are broadcast and their
    rows stay where they are; the other keys, none larger than that, are shuffled.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    limit = max(total // hot, 1)
    heavy = groups.where(F.col(count) > limit)
    heavy_keys = heavy.select(F.col(key).alias("_heavy"))
    tagged = rows.join(F.broadcast(heavy_keys), rows[key] == F.col("_heavy"), "left")
    on_heavy = tagged.where(F.col("_heavy").isNotNull()).drop("_heavy").join(F.broadcast(heavy), key, "inner")
    on_light = tagged.where(F.col("_heavy").isNull()).drop("_heavy").join(groups.where(F.col(count) <= limit), key, how)
    return on_heavy.unionByName(on_light)
