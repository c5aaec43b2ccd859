"""Rates, means and histograms over points, contacts and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """100 * rows in part of those in whole; null where there are none."""
    return F.try_divide(100.0 * F.count_if(part & whole), F.count_if(whole))


def consistency(error: Column, contact: Column) -> Column:
    """1 less the errors per contact."""
    return 1 - F.try_divide(F.count_if(error & contact).cast("double"), F.count_if(contact))


def truthy(value: str) -> Column:
    """Neither null, NaN nor zero."""
    return F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) != 0)


def truthy_mean(value: str) -> Column:
    """Mean over truthy values, null without any."""
    return F.avg(F.when(truthy(value), F.col(value)))


def week_start(day: Column) -> Column:
    """The Sunday of the day's week."""
    return F.date_sub(day.cast("date"), F.dayofweek(day) - 1)


def weekly(rows: DataFrame, time: str, *measures: Column) -> DataFrame:
    """week, the measures, and all_weeks, true of the one row over all rows, not over weekly means; rows without a
    time have a week of their own, null but not all_weeks."""
    return rows.withColumn("week", week_start(F.col(time))).rollup("week").agg(*measures, (F.grouping("week") == 1).alias("all_weeks"))


def last_days(rows: DataFrame, time: str, now: str, days: int = 7) -> DataFrame:
    """Rows of the last days before now, a timestamp literal."""
    return rows.where(F.col(time) > F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def heatmap(positions: DataFrame, x: Column, z: Column, width: int = 400, height: int = 700, scale: int = 250, left: float = 0.8, middle: int = 350, step: int = 5) -> DataFrame:
    """gx, gz, n, most: contacts by cell of the table seen from above, and the fullest cell's count."""
    cells = positions.select(((x + left) * scale).cast("int").alias("px"), (middle - (z * scale).cast("int")).alias("pz"))
    inside = cells.where(F.col("px").between(0, width - 1) & F.col("pz").between(0, height - 1))
    counted = inside.groupBy((F.col("px") - F.col("px") % step).alias("gx"), (F.col("pz") - F.col("pz") % step).alias("gz")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.max("n").alias("most"))))  # one row


def magnitude(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def vector_magnitude(values: str) -> Column:
    """Length of an array column, in whole-stage code."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")))


def spin(rz: str, top: bool) -> Column:
    """Topspin is rz unless negative, backspin its size unless positive."""
    return F.when(F.col(rz) < 0, 0.0 if top else F.abs(rz)).when(F.col(rz) > 0, F.col(rz) if top else 0.0).otherwise(F.col(rz) * 0)


def won_more(mine: Column, theirs: Column) -> Column:
    return mine > theirs


def follows(kind: str, by: list[str], order: list[str], what: str) -> Column:
    """Whether the row right before is of the kind `what`."""
    return F.coalesce(F.lag(kind).over(Window.partitionBy(*by).orderBy(*order)) == what, F.lit(False))


def last_earlier(rows: DataFrame, by: list[str], order: list[str], is_hit: Column, value: Column, name: str) -> DataFrame:
    """rows with the value of the latest earlier hit."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(is_hit, value), ignorenulls=True).over(before))


def trimmed_to_first(rows: DataFrame, by: list[str], order: list[str], starts: Column) -> DataFrame:
    """rows of each key from its first row that starts play; keys without one have none."""
    whole = Window.partitionBy(*by)
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    numbered = rows.withColumn("__no", number).withColumn("__start", starts)
    first = F.min(F.when(F.col("__start"), F.col("__no"))).over(whole)
    return numbered.withColumn("__first", first).where("__no >= __first").drop("__no", "__start", "__first")
