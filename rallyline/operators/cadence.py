"""Fitting a steady launch cadence to detected hits, and filling its empty slots.

Times are in any unit; a period's grid is given as a list of candidates, so that both sides of a comparison use the
same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_grid(first: float, last: float, step: float) -> list[float]:
    """first, first + step, ... up to last, by repeated addition as a running sum gives them."""
    values = [first]
    while values[-1] + step <= last + 1e-9:
        values.append(values[-1] + step)
    return values


def circular_residual(offset: Column, period: Column) -> Column:
    """offset brought into [-period/2, period/2)."""
    return F.pmod(offset + period / 2, period) - period / 2


def fit_period(hits: DataFrame, by: list[str], time: str, grid: Sequence[float], keep: float = 0.9, least: int = 3) -> DataFrame:
    """by, period: the candidate with the least mean of the smallest 90 % of residuals to the first hit's phase.

    Keys with fewer than `least` hits have none. A key's times are gathered once, as one array, and every candidate is
    tried on it in place, so hits are shuffled once, not once a candidate. Residuals and means are rounded to 9 places
    before they are compared, and the smaller period wins a tie.
    """
    known = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(time).cast("double"))).alias("__ts")).where(F.size("__ts") >= least)
    known = known.withColumn("__kept", F.greatest(F.lit(least), F.bround(F.size("__ts") * keep).cast("int")))
    offsets = F.transform("__ts", lambda t: t - F.element_at("__ts", 1))

    def tried(period: Column) -> Column:
        residuals = F.array_sort(F.transform("__offsets", lambda o: F.round(F.abs(circular_residual(o, period)), 9)))
        total = F.aggregate(F.slice(residuals, 1, F.col("__kept")), F.lit(0.0), lambda a, b: a + b)
        return F.struct(F.round(total / F.col("__kept"), 9).alias("mean"), period.alias("period"))

    candidates = F.array(*map(F.lit, map(float, grid)))
    return known.withColumn("__offsets", offsets).select(*by, F.array_min(F.transform(candidates, tried))["period"].alias("period"))


def fit_phase(hits: DataFrame, fitted: DataFrame, by: list[str], time: str) -> DataFrame:
    """by, period, phase: the first hit's time moved by the upper median of the signed residuals."""
    met = hits.join(fitted, by)
    first = F.min(time).over(Window.partitionBy(*by))
    residual = circular_residual(F.col(time) - F.col("__first"), F.col("period"))
    grouped = met.withColumn("__first", first).withColumn("__r", residual).groupBy(*by, "period")
    ordered = grouped.agg(F.min("__first").alias("__first"), F.sort_array(F.collect_list("__r")).alias("__rs"))
    middle = F.element_at("__rs", F.floor(F.size("__rs") / 2).cast("int") + 1)
    return ordered.select(*by, "period", (F.col("__first") + middle).alias("phase"))


def slots(fitted: DataFrame, evidence: DataFrame, by: list[str], time: str, total: Column, early: float = 0.3) -> DataFrame:
    """by, slot, anchor: anchors a period apart, back while no earlier than the first evidence less early periods, on
    to a period after the last evidence or the total, whichever comes first."""
    spread = evidence.groupBy(*by).agg(F.min(time).alias("__from"), F.max(time).alias("__to"))
    met = fitted.join(spread, by)
    back = F.floor((F.col("phase") - F.col("__from") + early * F.col("period")) / F.col("period")).cast("int")
    start = F.col("phase") - F.greatest(back, F.lit(0)) * F.col("period")
    horizon = F.least(total, F.bround(F.col("__to") + F.col("period")).cast("double"))
    count = F.greatest(F.floor((horizon - F.col("__start")) / F.col("period")).cast("int"), F.lit(-1))
    met = met.withColumn("__start", start).withColumn("__count", count).where("__count >= 0")
    exploded = met.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("__count"))))
    return exploded.select(*by, "slot", "period", F.bround(F.col("__start") + F.col("slot") * F.col("period")).cast("long").alias("anchor"))


def fill(slotted: DataFrame, matched: DataFrame, by: list[str], empty: str = "miss", confidence: float = 0.3) -> DataFrame:
    """Each slot with its outcome and confidence; one that nothing matched is a miss of low confidence."""
    joined = slotted.join(matched.select(*by, "slot", "outcome", "confidence"), [*by, "slot"], "left")
    return joined.withColumn("outcome", F.coalesce("outcome", F.lit(empty))).withColumn("confidence", F.coalesce("confidence", F.lit(confidence)))


def daily_slots(rows: DataFrame, by: list[str], day: Column) -> DataFrame:
    """by, day, n for every day from a key's first to its last; days without rows have 0."""
    counted = rows.groupBy(*by, day.alias("day")).agg(F.count("*").alias("n"))
    spread = counted.groupBy(*by).agg(F.min("day").alias("a"), F.max("day").alias("z"))
    every = spread.select(*by, F.explode(F.sequence("a", "z")).alias("day"))
    return every.join(counted, [*by, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
