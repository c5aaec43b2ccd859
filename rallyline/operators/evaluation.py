"""Labels against predictions: alignment, confusion counts, review manifests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.operators.temporal import interval_join

ALIGNMENT = "kind string, expected_index long, actual_index long"
MATCH, WRONG, MISSING, EXTRA = "match", "wrong_outcome", "missing", "extra"


def align(expected: list[str], actual: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Least-cost alignment of two sequences at unit costs: (kind, place in expected, place in actual), in order.

    Of equal costs a pair is preferred to a missing item and that to an extra one, as seen from the end. Only a band
    around the diagonal is worked out, a row of it at a time; it is widened until the cost shows that no best alignment
    can leave it, so time and memory follow the length times the number of differences.
    """
    codes = {o: k for k, o in enumerate(dict.fromkeys([*expected, *actual]))}
    wanted, got = (np.array([codes[o] for o in side], np.int32) for side in (expected, actual))
    band = abs(len(wanted) - len(got)) + 8
    while True:
        cost, moves = _banded(wanted, got, band)
        if cost <= band:
            break
        band *= 2
    out, i, j = [], len(wanted), len(got)
    while i or j:
        move = moves[i][j - i + band]
        i, j = i - (move != EXTRA_MOVE), j - (move != MISSING_MOVE)
        if move == PAIR_MOVE:
            out.append((MATCH if wanted[i] == got[j] else WRONG, i, j))
        else:
            out.append((MISSING, i, None) if move == MISSING_MOVE else (EXTRA, None, j))
    return out[::-1]


PAIR_MOVE, MISSING_MOVE, EXTRA_MOVE = 0, 1, 2


def _banded(wanted: np.ndarray, got: np.ndarray, band: int) -> tuple[int, list[np.ndarray]]:
    """The cost within the band, and for each row (a prefix of wanted) the last move to each place of the band, which
    at d holds the prefix of got that is d - band longer."""
    far = len(wanted) + len(got) + 1
    places = np.arange(2 * band + 1)
    row, moves = np.where((places >= band) & (places - band <= len(got)), places - band, far), [np.full(2 * band + 1, EXTRA_MOVE, np.uint8)]
    for i in range(1, len(wanted) + 1):
        j = places + i - band
        inside = (j >= 1) & (j <= len(got))
        differs = np.ones(2 * band + 1, np.int64)
        differs[inside] = wanted[i - 1] != got[j[inside] - 1]
        pair = np.where(inside, row + differs, far)
        missing = np.where((j >= 0) & (j <= len(got)), np.append(row[1:], far) + 1, far)
        row = np.minimum(np.minimum.accumulate(np.minimum(pair, missing) - places) + places, far)  # extra items after it
        row = np.where((j >= 0) & (j <= len(got)), row, far)
        moves.append(np.where(row == pair, PAIR_MOVE, np.where(row == missing, MISSING_MOVE, EXTRA_MOVE)).astype(np.uint8))
    return int(row[len(got) - len(wanted) + band]), moves


def align_by(expected: DataFrame, actual: DataFrame, by: str, order: str, outcome: str) -> DataFrame:
    """by and ALIGNMENT for each key: one task a key, whose sequences are a recording's attempts."""
    kind = expected.schema[by].dataType.simpleString()

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = (side.sort_values(order)[outcome].tolist() for side in (left, right))
        rows = align(*sides)
        frame = pd.DataFrame(rows, columns=["kind", "expected_index", "actual_index"])
        for column in ("expected_index", "actual_index"):
            frame[column] = frame[column].astype("Int64")
        frame.insert(0, by, key[0])
        return frame

    sides = (side.select(by, order, outcome).groupBy(by) for side in (expected, actual))
    left, right = sides
    return left.cogroup(right).applyInPandas(one, f"{by} {kind}, {ALIGNMENT}")


def binary(outcome: Column) -> Column:
    """hit, or miss for anything else."""
    return F.when(outcome == "hit", "hit").otherwise("miss")


def sequence_counts(aligned: DataFrame, *by: str) -> DataFrame:
    """by, match, wrong_outcome, missing, extra and accuracy, the matches' share of all."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in (MATCH, WRONG, MISSING, EXTRA)]
    return aligned.groupBy(*by).agg(*counts, F.coalesce(F.try_divide(F.count_if(F.col("kind") == MATCH).cast("double"), F.count("*")), F.lit(0.0)).alias("accuracy"))


def confusion(pairs: DataFrame, truth: Column, guess: Column, *by: str) -> DataFrame:
    """by, true_hit, false_hit, true_miss, false_miss, precision, recall, f1; 0 where there is nothing to divide by."""
    counted = pairs.groupBy(*by).agg(
        F.count_if(truth & guess).alias("true_hit"), F.count_if(~truth & guess).alias("false_hit"),
        F.count_if(~truth & ~guess).alias("true_miss"), F.count_if(truth & ~guess).alias("false_miss"),
    )

    def share(part: str, *rest: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), sum((F.col(r) for r in rest), F.col(part))), F.lit(0.0))

    rated = counted.withColumn("precision", share("true_hit", "false_hit")).withColumn("recall", share("true_hit", "false_miss"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rated.withColumn("f1", f1)


def hit_pairs(aligned: DataFrame, labels: DataFrame, predictions: DataFrame, by: str) -> DataFrame:
    """by, truth, guess of what the alignment says of hits: pairs, a missing hit as a miss, an extra hit as a false one.

    Missing and extra misses are in no cell, so the cells need not add up to the alignment.
    """
    wanted = labels.select(by, F.col("place").alias("expected_index"), F.col("outcome").alias("expected"))
    got = predictions.select(by, F.col("place").alias("actual_index"), F.col("outcome").alias("actual"))
    met = aligned.join(wanted, [by, "expected_index"], "left").join(got, [by, "actual_index"], "left")
    truth, guess = F.col("expected") == "hit", F.col("actual") == "hit"
    known = F.coalesce(truth, F.lit(False)), F.coalesce(guess, F.lit(False))
    return met.where(F.col("expected").isNotNull() & F.col("actual").isNotNull() | known[0] | known[1]).select(by, known[0].alias("truth"), known[1].alias("guess"))


def assert_resolved(labels: DataFrame, outcome: str = "outcome") -> DataFrame:
    """labels; reading them fails if one is neither hit nor miss."""
    unsure = F.raise_error(F.lit("ground truth has unresolved labels")).cast("boolean")
    return labels.where(F.when(F.coalesce(F.col(outcome).isin("hit", "miss"), F.lit(False)), F.lit(True)).otherwise(unsure))


def error_rows(aligned: DataFrame, labels: DataFrame, predictions: DataFrame, by: str, fps: float = 60.0) -> DataFrame:
    """by, kind and both sides of every alignment item that is no match; numbers count from 1.

    labels(by, place, outcome, time_seconds), predictions(by, place, outcome, frame); a prediction's time is its
    attempt's frame at fps.
    """
    wanted = labels.select(by, F.col("place").alias("expected_index"), F.col("outcome").alias("expected_outcome"), F.col("time_seconds").alias("label_time_seconds"))
    got = predictions.select(by, F.col("place").alias("actual_index"), F.col("outcome").alias("predicted_outcome"), (F.col("frame") / fps).alias("prediction_time_seconds"))
    met = aligned.where(F.col("kind") != MATCH).join(wanted, [by, "expected_index"], "left").join(got, [by, "actual_index"], "left")
    return met.select(by, "kind", (F.col("expected_index") + 1).alias("expected_number"), "expected_outcome", "label_time_seconds", (F.col("actual_index") + 1).alias("predicted_number"), "predicted_outcome", "prediction_time_seconds")


def placed(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with their place, from 0, within each key."""
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def review_manifest(errors: DataFrame, diagnostics: DataFrame, by: str, fps: float = 60.0, before: float = 2.0, after: float = 2.0) -> DataFrame:
    """One row an error of error_rows(): its number, anchor, clips, and the diagnostics near its anchor.

    diagnostics(by, reason, points array<array<double>>): those with points whose frame is within before + after
    seconds of the anchor. A diagnostic's frame is the hit_frame named in its reason, else that of its last point;
    its signal is the first word of the reason.
    """
    anchor = F.coalesce("prediction_time_seconds", "label_time_seconds")
    order = Window.partitionBy(by).orderBy(F.coalesce("expected_number", "predicted_number"), "predicted_number", "kind")
    reviews = errors.withColumn("__anchor", anchor).withColumn("review_number", F.row_number().over(order))
    number = F.col("review_number").cast("string")
    name = F.concat_ws("-", F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")), "kind", F.lit("expected"), F.coalesce(F.col("expected_number").cast("string"), F.lit("none")))
    reviews = reviews.withColumns({
        "anchor_time_seconds": F.round("__anchor", 3), "clip_start_seconds": F.round(F.greatest(F.lit(0.0), F.col("__anchor") - before), 3),
        "clip_duration_seconds": F.lit(round(before + after, 3)), "raw_clip": F.concat(F.lit("raw/"), name, F.lit(".mp4")),
        "annotated_clip": F.concat(F.lit("annotated/"), name, F.lit(".mp4")), "__frame": F.bround(F.col("__anchor") * fps).cast("long"),
    })
    named = F.nullif(F.regexp_extract("reason", r"(?:^|\s)hit_frame=(\d+)", 1), F.lit("")).cast("long")
    last = F.element_at("points", -1)[0].cast("long")
    signal = F.nullif(F.regexp_extract("reason", r"^\s*(\S*)", 1), F.lit(""))
    near = diagnostics.where(F.size("points") > 0).select(
        by, F.coalesce(named, last).alias("hit_frame"), signal.alias("signal"), F.element_at("points", 1)[0].cast("long").alias("track_start_frame"), last.alias("track_end_frame"), "points"
    )
    met = interval_join(reviews.select(by, "review_number", "__frame"), near, [by], "__frame", "hit_frame", round((before + after) * fps))
    found = F.struct("hit_frame", F.round(F.col("hit_frame") / fps, 3).alias("time_seconds"), "signal", "track_start_frame", "track_end_frame", "points")
    listed = met.groupBy(by, "review_number").agg(F.sort_array(F.collect_list(found)).alias("nearby_bounce_diagnostics"))
    return reviews.drop("__anchor", "__frame").join(listed, [by, "review_number"], "left")


def label_problems(labels: DataFrame) -> DataFrame:
    """labels with the reason why each may not be stored, null if it may: time_seconds and outcome are checked."""
    reason = F.when(~F.coalesce(F.col("outcome").isin("hit", "miss", "uncertain"), F.lit(False)), "outcome").when(F.col("time_seconds").isNull() | F.isnan("time_seconds") | ~F.col("time_seconds").between(0, 1e300), "time")
    return labels.withColumn("problem", reason)


def label_counts(labels: DataFrame, *by: str) -> DataFrame:
    return labels.groupBy(*by).agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in ("hit", "miss", "uncertain")))
