"""Joins by nearness in time. Sides meet in one shuffle by key and order, not in a product of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stacked(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str) -> DataFrame:
    """Both sides as one table (by, __t, __side, __l, __r); right sorts before left at the same time."""
    mine = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("__r"))
    theirs = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), F.struct(*right.columns).alias("__r"))
    return mine.unionByName(theirs)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, k: int = 1) -> DataFrame:
    """left's columns and matches: up to k structs of right at or before left's time, the latest first.

    Rows of right get their k-1 predecessors by lag, so the last non-null row before a left row carries all k. A row
    of right without a time is no match, and a row of left without one has none.
    """
    right = right.where(F.col(right_time).isNotNull())
    order = Window.partitionBy(*by).orderBy(right_time)
    own = F.struct(*right.columns)
    chain = right.select(*by, F.col(right_time).alias("__rt"), F.array_compact(F.array(own, *(F.lag(own, i).over(order) for i in range(1, k)))).alias("__m"))
    both = _stacked(left, chain, by, left_time, "__rt")
    before = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__hit", F.last(F.col("__r.__m"), ignorenulls=True).over(before)).where("__side = 1")
    return met.select("__l.*", F.when(F.col("__t").isNotNull(), F.col("__hit")).alias("matches"))


def nearest_within(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tolerance: Column) -> DataFrame:
    """left's columns and match: the struct of right nearest in time, if within tolerance; the earlier one on a tie.

    Of right rows at one time any may be the match; times are numbers or of one numeric scale. Rows without a time
    match nothing.
    """
    right = right.where(F.col(right_time).isNotNull())
    both = _stacked(left, right, by, left_time, right_time)
    order = Window.partitionBy(*by).orderBy("__t", "__side")
    back = F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    met = both.withColumn("__b", back).withColumn("__a", ahead).where("__side = 1")
    gap_back, gap_ahead = F.col("__t") - F.col(f"__b.{right_time}"), F.col(f"__a.{right_time}") - F.col("__t")
    best = F.when(F.col("__a").isNull() | (gap_back <= gap_ahead), F.col("__b")).otherwise(F.col("__a"))
    met = met.withColumn("__best", best)
    near = F.abs(F.col(f"__best.{right_time}") - F.col("__t")) <= tolerance
    return met.select("__l.*", F.when(near, F.col("__best")).alias("match"))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, reach: int) -> DataFrame:
    """Pairs of rows of one key at most reach apart in (integer) time; right's columns must not clash beyond by.

    Both sides are dealt into time cells of the reach's width; a left row visits its own cell and the two beside
    it, so the join is an equality on key and cell, whatever the key's share of all rows.
    """
    width = max(reach, 1)
    cell = F.floor(F.col(left_time) / width)
    visiting = left.withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    at_home = right.withColumn("__cell", F.floor(F.col(right_time) / width))
    close = F.abs(F.col(left_time) - F.col(right_time)) <= reach
    return visiting.join(at_home, [*by, "__cell"]).where(close).drop("__cell")


def reconnect(ends: DataFrame, starts: DataFrame, by: list[str], most_gap: int, forward: tuple[float, float], fastest: float) -> DataFrame:
    """For each fragment start the end it continues, if any: (by, start's and end's columns).

    ends(by, end_id, end_t, end_x), starts(by, start_id, start_t, start_x). An end may be 1 to most_gap time units
    earlier and forward units behind, at no more than fastest a unit; the smallest gap wins, then the largest
    step forward, then the smallest end_id.
    """
    pairs = interval_join(starts, ends, by, "start_t", "end_t", most_gap)
    gap, step = F.col("start_t") - F.col("end_t"), F.col("start_x") - F.col("end_x")
    fits = (gap > 0) & (gap <= most_gap) & step.between(*forward) & (F.abs(step) <= fastest * gap)
    rank = Window.partitionBy(*by, "start_id").orderBy(gap, -step, "end_id")
    return pairs.where(fits).withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")


def nearest_slot(hits: DataFrame, slots: DataFrame, by: list[str], hit_time: str, slot_time: str, tolerance: Column, strength: str, hit_id: str) -> DataFrame:
    """At most one hit a slot: each hit goes to its nearest slot within tolerance; a slot keeps the nearest, then the
    strongest, then the first."""
    met = nearest_within(hits, slots, by, hit_time, slot_time, tolerance).where("match is not null")
    rank = Window.partitionBy(*by, F.col(f"match.{slot_time}")).orderBy(F.abs(F.col(f"match.{slot_time}") - F.col(hit_time)), F.col(strength).desc(), F.col(hit_time), F.col(hit_id))
    return met.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")


def without(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """rows whose keys are not in others; a null key is never in."""
    return rows.join(others.select(*keys).distinct(), list(keys), "left_anti")


def union_unless_same(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """All of first, and of second what has no row in first with the same keys."""
    return first.unionByName(without(second, first, *keys))
