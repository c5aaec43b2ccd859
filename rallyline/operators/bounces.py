"""Table contacts of finished tracks, by array functions over each track's points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.functions import scalars


@dataclass(frozen=True)
class BounceLimits:
    """Points and pixels, speeds in pixels a frame."""

    least_points: int = 9
    shadow_score: float = 28
    margin: float = 10
    net_distance: float = 70
    terminal_frames: int = 2
    turn: float = 1
    fast_before: float = 12
    slow_share: float = 0.35
    flattening_weight: float = 0.6


def find_bounces(tracks: DataFrame, polygon: list[tuple[float, float]], net_line: tuple[tuple[float, float], tuple[float, float]] | None = None, limits: BounceLimits = BounceLimits(), allow_terminal: bool = True) -> DataFrame:
    """tracks(points array<struct<frame,x,y,score>>) with bounce: struct(hit, approach, departure, signal), or null.

    A shadow that closes up on the ball at the table is a contact at once. Else the strongest turn or flattening of the
    path over the table is, if the ball moves on to the right before and after it; the first of equals.
    """
    points, n = F.col("points"), F.size("points")
    at = lambda i: F.element_at("points", (i + 1).cast("int"))
    part = lambda i, k: F.slice("points", (i + 1).cast("int"), k)
    near = lambda p: scalars.near_polygon(p["x"], p["y"], polygon, limits.margin)
    mean = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda t, v: t + v) / F.size(a)

    def shadow(i: Column) -> Column:
        p, before = at(i), at(i - 1)
        after = F.try_element_at("points", (i + 2).cast("int"))
        terminal = i >= n - limits.terminal_frames
        good = (p["score"] >= limits.shadow_score) & near(p) & (p["score"] >= before["score"]) & (after.isNull() | (p["score"] > after["score"])) & (p["x"] >= before["x"])
        if net_line is not None:
            good = good & (F.abs(scalars.line_side(p["x"], p["y"], net_line)) >= limits.net_distance)
        return good & (~terminal | (F.lit(allow_terminal) & (p["x"] > at(i - 2)["x"])))

    def contact(i: Column) -> Column:
        """Strength of the turn or flattening at i; null if there is none."""
        y, before, after = at(i)["y"], part(i - 3, 3), part(i + 1, 2)
        up, down = y - mean(before, lambda p: p["y"]), y - mean(after, lambda p: p["y"])
        turned = ((up >= limits.turn) & (down >= limits.turn)) | ((up <= -limits.turn) & (down <= -limits.turn))
        fast = (F.abs(at(i)["y"] - at(i - 1)["y"]) + F.abs(at(i - 1)["y"] - at(i - 2)["y"]) + F.abs(at(i - 2)["y"] - at(i - 3)["y"])) / 3
        slow = (F.abs(at(i + 1)["y"] - y) + F.abs(at(i + 2)["y"] - at(i + 1)["y"])) / 2
        flat = (fast >= limits.fast_before) & (slow <= fast * limits.slow_share)
        onward = (at(i)["x"] >= at(i - 1)["x"]) & (at(i - 2)["x"] > at(i - 3)["x"]) & (at(i - 1)["x"] > at(i - 2)["x"]) & (at(i + 2)["x"] > at(i)["x"])
        strength = F.greatest(F.when(turned, F.least(F.abs(up), F.abs(down))), F.when(flat, (fast - slow) * limits.flattening_weight))
        return F.when(near(at(i)) & onward, strength)

    first_shadow = F.try_element_at(F.filter(F.sequence(F.lit(2), n - 1), shadow), F.lit(1))
    rated = F.filter(F.transform(F.sequence(F.lit(3), n - 3), lambda i: F.struct(contact(i).alias("s"), (-i).alias("i"))), lambda c: c["s"].isNotNull())
    strongest = -F.array_max(rated)["i"]
    enough = n >= limits.least_points
    by_shadow = F.struct(at(F.col("__shadow")).alias("hit"), part(F.col("__shadow") - 2, 2).alias("approach"), part(F.col("__shadow") + 1, 2).alias("departure"))
    by_turn = F.struct(at(F.col("__turn")).alias("hit"), part(F.col("__turn") - 3, 3).alias("approach"), part(F.col("__turn") + 1, 2).alias("departure"))
    found = tracks.withColumn("__shadow", F.when(enough, first_shadow)).withColumn("__turn", F.when(enough & F.col("__shadow").isNull(), strongest))
    found = found.withColumn("__b", F.when(F.col("__shadow").isNotNull(), by_shadow).when(F.col("__turn").isNotNull(), by_turn))
    ys = lambda a: F.transform(a, lambda p: p["y"])
    signal = scalars.bounce_signal(F.col("__b.hit.y"), ys("__b.approach"), ys("__b.departure"))
    return found.withColumn("bounce", F.when(F.col("__b").isNotNull(), F.struct("__b.hit", "__b.approach", "__b.departure", signal.alias("signal")))).drop("__shadow", "__turn", "__b")


def non_bounce_outcome(tracks: DataFrame, polygon: list[tuple[float, float]], net_line: tuple[tuple[float, float], tuple[float, float]], crossed: str = "crossed_net", net_share: float = 0.2) -> DataFrame:
    """video_id, attempt, outcome, confidence of attempts without a bounce, from their return tracks.

    tracks(video_id, attempt, points, crossed_net); an attempt without a return has one row with null points. The return
    that crossed the net and ended off the table counts most, then the longest.
    """
    last = F.element_at("points", -1)
    on_table = scalars.in_polygon(last["x"], last["y"], polygon)
    (x0, y0), (x1, y1) = net_line
    length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    at_net = F.abs(scalars.line_side(last["x"], last["y"], net_line)) <= net_share * length
    rated = tracks.withColumns({"__off": ~on_table, "__net": at_net, "__crossed": F.coalesce(F.col(crossed), F.lit(False)), "__n": F.coalesce(F.size("points"), F.lit(0))})
    best = rated.groupBy("video_id", "attempt").agg(F.max_by(F.struct("points", "__off", "__net", "__crossed"), F.struct(F.coalesce(F.col("__crossed") & F.col("__off"), F.lit(False)), "__n")).alias("b"))
    none, off, over = F.col("b.points").isNull(), F.col("b.__off"), F.col("b.__crossed")
    outcome = F.when(none, "unknown").when(off, "off_table").when(over, "unknown").when(F.col("b.__net"), "net").otherwise("unknown")
    confidence = F.when(none, 0.2).when(off, 0.58).when(over, 0.5).when(F.col("b.__net"), 0.55).otherwise(0.35)
    return best.select("video_id", "attempt", outcome.alias("outcome"), confidence.alias("confidence"))


def camera_regions(geometry: DataFrame) -> DataFrame:
    """geometry with launcher_region, return_region and tracking_region: (left, top, right, bottom) arrays.

    geometry(camera_id, width, height, table_top, table_bottom, player_x, opponent_x). With the opponent to the right the
    launcher is on the right of the view and returns come from its left; else the other way round. Edges of the view
    are its last pixels; a table is taken to be a pixel high or more.
    """
    right, w, h = F.col("opponent_x") >= F.col("player_x"), F.col("width").cast("double"), F.col("height").cast("double")
    box = lambda a, b: F.array(w * a, F.lit(0.0), w - 1 if b == 1 else w * b, h - 1)
    tall = F.greatest(F.col("table_bottom") - F.col("table_top"), F.lit(1.0))
    corridor = F.array(F.lit(0.0), F.greatest(F.lit(0.0), F.col("table_top") - 1.5 * tall), w - 1, F.least(h - 1, F.col("table_bottom") + 0.5 * tall))
    return geometry.withColumns({
        "launcher_region": F.when(right, box(0.58, 1.0)).otherwise(box(0.0, 0.42)),
        "return_region": F.when(right, box(0.0, 0.28)).otherwise(box(0.72, 1.0)), "tracking_region": corridor,
    })
