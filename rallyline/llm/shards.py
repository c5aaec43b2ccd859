"""Operator 10: sharding by vector bin packing.

Groups of equal texts are gathered by hash into cells, whose number is fixed; a group that alone weighs more
than a cell may is dealt over cells of its own. The driver places the cells, heaviest first, each where the
dot product of its bytes, tokens and rows with the shard's residual capacity is highest, among those with room for its
bytes. The cells of a group are placed as one; only if shards get uneven are the largest groups split, and then only
those above as large a part of a shard as does.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm.common import map_blocks, text_rows
from rallyline.session import settle


@dataclass(frozen=True)
class Plan:
    """Shards; hashed cells; a group above one part in `fine` of a shard is dealt over several cells; how much fuller
    than the mean a shard may be before groups are split; what each measure counts for."""

    shards: int = 16
    cells: int = 1 << 16
    fine: int = 64
    even: float = 0.01
    weights: tuple[float, float, float] = (4.0, 1.0, 1.0)  # bytes, tokens, rows: the law is near equal bytes


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes and 1), tokens (words, or eight bytes each if those are more, and 1), crc, key (of the text),
    a row each; null counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        columns = [
            pa.array([len(t) + 1 for t in raw], pa.int64()), pa.array([max(len(t.split()), len(t) // 8) + 1 for t in raw], pa.int64()),
            pa.array([zlib.crc32(t) for t in raw], pa.int64()), pa.array([blake2b(t, digest_size=16).digest() for t in raw], pa.binary()),
        ]
        return pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "size", "tokens", "crc", "key"])

    return map_blocks(text_rows(docs), work, "doc_id long, size long, tokens long, crc long, key binary")


def place(loads: np.ndarray, plan: Plan) -> np.ndarray:
    """The shard of each cell; loads has a row a cell with its bytes, tokens and rows."""
    share = loads / np.maximum(loads.sum(0), 1) * plan.shards
    weights = np.array(plan.weights) / sum(plan.weights)
    residual = np.ones((plan.shards, loads.shape[1]))
    shard = np.zeros(len(loads), np.int64)
    for i in np.argsort(-share.max(1), kind="stable"):
        score = np.maximum(residual, -1) @ (weights * share[i])
        fits = residual[:, 0] >= share[i, 0]  # bytes are the law; of the others a shard may hold more than its part
        if fits.any():
            score = np.where(fits, score, -np.inf)
        shard[i] = best = int(np.argmax(score))
        residual[best] -= share[i]
    return shard


def place_groups(cells: pd.DataFrame, plan: Plan) -> np.ndarray:
    """The shard of each cell of cells(cell, b, t, n); "g/k" names the k-th cell of group g. Groups are whole if shards
    get even so; else those above a half, a quarter and so on of a shard are split."""
    group = cells["cell"].astype(str).str.extract(r"^(\d+)/", expand=False)  # null for hashed cells
    part = cells.groupby(group)["b"].sum() / max(cells["b"].sum() / plan.shards, 1)
    most = 1.0
    while True:
        whole = group.map(part).le(most)
        unit = (group + "/").where(whole, cells["cell"])
        loads = cells.groupby(unit, sort=True)[["b", "t", "n"]].sum()
        shard = unit.map(dict(zip(loads.index, place(loads.to_numpy(float).reshape(-1, 3), plan), strict=True))).to_numpy(np.int64)
        fullest = np.bincount(shard, cells["b"], plan.shards).max() if len(cells) else 0
        if fullest <= (1 + plan.even) * cells["b"].sum() / plan.shards or not whole.any():
            return shard
        most /= 2


def assign(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), tokens.

    Rows with the same text share a shard, unless shards would be uneven by more than plan.even so: then the largest
    groups are split by row. Null and empty texts are one group of size 1 each. Slots of a
    shard run from 0 without gaps. Repeated rows and null ids each have a slot of their own; no rows give none.
    Only narrow rows are shuffled, each cell a small and bounded share of them; the driver sees cells only.
    """
    rows = settle(sizes(docs).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("size", "b"), ("tokens", "t"))), F.count("*").alias("n")).first()
    most = [max(v / (plan.shards * plan.fine), 1) for v in total]
    per_group = rows.groupBy("key").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    over = F.greatest(*(F.col(c) / m for c, m in zip("btn", most, strict=True)))
    # Of each measure at most shards * fine groups can be that heavy, so these rows are bounded whatever the input.
    heavy = per_group.where((over > 1) & (F.col("n") > 1)).select("key", F.ceil(over).cast("long").alias("pieces"))
    heavy = settle(heavy.withColumn("group", F.row_number().over(Window.orderBy("key"))))
    own = F.concat_ws("/", "group", F.pmod(F.xxhash64("row"), "pieces"))
    hashed = F.pmod(F.xxhash64("key"), F.lit(plan.cells)).cast("string")
    rows = rows.join(F.broadcast(heavy), "key", "left").withColumn("cell", F.when(F.col("pieces").isNull(), hashed).otherwise(own))
    # At most plan.cells cells and the pieces of the heavy groups.
    cells = rows.groupBy("cell").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).toPandas().sort_values("cell")
    cells["shard"] = place_groups(cells.reset_index(drop=True), plan)
    cells["first"] = cells.groupby("shard")["n"].cumsum() - cells["n"]
    found = [(c, int(s), int(f)) for c, s, f in zip(cells["cell"], cells["shard"], cells["first"], strict=True)]
    placed = rows.sparkSession.createDataFrame(found, "cell string, shard int, first long")
    order = Window.partitionBy("cell").orderBy("row")
    return rows.withColumn("n", F.row_number().over(order)).join(F.broadcast(placed), "cell").select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
