"""The attempt ledger in batch form: upserts, streaks and publication checks."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit_streak(attempts: DataFrame, by: list[str], order: list[str], hit: Column, name: str = "streak") -> DataFrame:
    """attempts with the number of hits in a row up to and including each; any other outcome starts anew.

    Gaps and islands: misses so far number the islands, and hits are summed within one.
    """
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = attempts.withColumn("__island", F.sum(F.when(hit, 0).otherwise(1)).over(so_far))
    within = Window.partitionBy(*by, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn(name, F.sum(F.when(hit, 1).otherwise(0)).over(within).cast("long")).drop("__island")


def running_best(streaks: DataFrame, by: list[str], order: list[str], streak: str = "streak", name: str = "best") -> DataFrame:
    """The best streak so far at each attempt."""
    return streaks.withColumn(name, F.max(streak).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def merge_upserts(upserts: DataFrame, by: list[str], arrival: list[str], final: Column) -> DataFrame:
    """One row per key: the first final row to arrive, which nothing later may change, or else the last pending one."""
    rank = Window.partitionBy(*by).orderBy(F.when(final, 0).otherwise(1), F.when(final, F.struct(*arrival)).asc_nulls_last(), F.struct(*arrival).desc())
    return upserts.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def arrival_streak(attempts: DataFrame, by: list[str], arrival: str, time: str, hit: Column) -> DataFrame:
    """by, arrival, streak: the streak at the end of what has arrived so far, put in order of time.

    Hits that arrived no later than a row count if no miss that had arrived by then is later in time. A key is folded
    once in order of arrival: the hits that count are a heap by time, from which a later miss takes all before it for
    good, so a key of n rows takes n log n steps.
    """
    rows = attempts.select(*by, F.col(arrival), F.col(time).alias("__time"), hit.alias("__hit"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counting, missed, streaks = [], None, []
        group = group.sort_values([arrival, "__hit"], ascending=[True, False])
        for at, is_hit in zip(group["__time"], group["__hit"], strict=True):
            if not is_hit:
                missed = at if missed is None else max(missed, at)
                while counting and counting[0] <= missed:
                    heapq.heappop(counting)
            elif missed is None or at > missed:
                heapq.heappush(counting, at)
            streaks.append(len(counting))
        return group.assign(streak=streaks)[[*by, arrival, "streak"]]

    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, arrival)) + ", streak long")


def repeated_keys(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > 1)


def compare_by_position(expected: DataFrame, actual: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, place, expected, actual, same: two sequences side by side; the shorter one is null at its end."""

    def placed(rows: DataFrame, name: str) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
        return rows.select(*by, number.alias("place"), F.col(value).alias(name))

    both = placed(expected, "expected").join(placed(actual, "actual"), [*by, "place"], "full")
    return both.withColumn("same", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def with_publication(upserts: DataFrame, now: Column, fps: float = 60.0) -> DataFrame:
    """upserts(state, anchor_frame_number, frame_number, ...) with when they went out, the frame `now`, and, if final, how
    long after their evidence (its anchor, if there is none) and after their launch that was."""
    final, evidence = F.col("state") == "finalized", F.coalesce("frame_number", "anchor_frame_number")
    seconds = lambda frames: F.round(frames / fps, 3)
    return upserts.withColumns({
        "type": F.lit("attempt_upsert"), "publication_frame_number": now, "publication_video_time_seconds": seconds(now),
        "publication_delay_frames": F.when(final, now - evidence), "publication_delay_seconds": F.when(final, seconds(now - evidence)),
        "attempt_publication_delay_seconds": F.when(final, seconds(now - F.col("anchor_frame_number"))),
    })


def late_publications(finalized: DataFrame, limits: DataFrame, outcome: str, delay: str, limit: str) -> DataFrame:
    """finalized rows whose delay is above the limit of their outcome; limits is a small table, joined as Spark sees fit."""
    return finalized.join(limits, outcome).where(F.col(delay) > F.col(limit))


def replay_mismatches(expected: DataFrame, actual: DataFrame, limits: DataFrame) -> DataFrame:
    """check, video, detail: all that is wrong with a replayed ledger, as one table.

    expected(video, sequence, outcome); actual(video, sequence, attempt_id, anchor_frame_number, outcome, delay), and
    streak, if the counter that was replayed showed one; limits(outcome, limit). A streak counts hits by anchor frame,
    from the last miss on.
    """
    sides = compare_by_position(expected, actual, ["video"], ["sequence"], "outcome").where("not same")
    outcomes = sides.select(F.lit("outcome").alias("check"), "video", F.format_string("#%d: expected %s, got %s", "place", F.coalesce("expected", F.lit("-")), F.coalesce("actual", F.lit("-"))).alias("detail"))
    lengths = expected.groupBy("video").agg(F.count("*").alias("a")).join(actual.groupBy("video").agg(F.count("*").alias("b")), "video", "full")
    lengths = lengths.where("not (a <=> b)").select(F.lit("length").alias("check"), "video", F.format_string("%d expected, %d published", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("detail"))
    parts = [outcomes, lengths]
    for check, key in (("same_frame", "anchor_frame_number"), ("same_id", "attempt_id")):
        parts.append(repeated_keys(actual, "video", key).select(F.lit(check).alias("check"), "video", F.format_string("%s occurs %d times", F.col(key).cast("string"), "n").alias("detail")))
    if "streak" in actual.columns:
        due = hit_streak(actual.where("outcome in ('hit', 'miss')").withColumnRenamed("streak", "__shown"), ["video"], ["anchor_frame_number", "sequence"], F.col("outcome") == "hit")
        wrong = due.where("not (streak <=> __shown)")
        parts.append(wrong.select(F.lit("streak").alias("check"), "video", F.format_string("%s shows %s, not %d", "attempt_id", F.coalesce(F.col("__shown").cast("string"), F.lit("-")), "streak").alias("detail")))
    late = late_publications(actual, limits, "outcome", "delay", "limit")
    parts.append(late.select(F.lit("late").alias("check"), "video", F.format_string("%s after %.3f s", "attempt_id", F.col("delay").cast("double")).alias("detail")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
