"""Ball tracks from per-frame candidates, and what a finished track is evidence of."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rallyline.functions import scalars

Point = tuple[int, float, float, float]  # frame, x, y, shadow score
TRACKS = "video_id string, track_no int, points array<struct<frame:int,x:double,y:double,score:double>>"


@dataclass(frozen=True)
class TrackLimits:
    """Fixed values of linking: speeds in pixels a frame, distances in pixels, turns in degrees."""

    max_gap: int = 5
    confirmed_at: int = 3
    slowest: float = 0.5
    fastest: float = 200
    match_distance: float = 100
    prediction_error: float = 100
    error_per_gap: float = 10
    acceleration: float = 200
    turn: float = 170

    def but(self, **changes: float) -> TrackLimits:
        """These limits with some of a camera's own; names that are none are ignored."""
        return replace(self, **{k: v for k, v in changes.items() if k in self.__dataclass_fields__})


@dataclass
class Live:
    points: list[Point]
    gap: int = 0


def link_errors(tracks: list[list[Point]], frame: int, places: np.ndarray, limits: TrackLimits) -> np.ndarray:
    """A row a track and a column a candidate: how far the candidate is from where the track should be one observation
    on, infinite where it can't be its next point. places has x and y of each candidate.

    All pairs are worked out at once; every limit is a mask over them. A track of one point has no velocity, so its
    error is the distance and only its speed is limited.
    """
    two = np.array([[t[-2] if len(t) > 1 else t[-1], t[-1]] for t in tracks], float).reshape(-1, 2, 4)
    is_new = np.array([len(t) == 1 for t in tracks], bool)[:, None]
    elapsed = frame - two[:, 1, :1]
    before = np.maximum(two[:, 1, 0] - two[:, 0, 0], 0)[:, None]
    stride = np.where(before > 0, two[:, 1, 1:3] - two[:, 0, 1:3], 0.0)
    moved = places[None] - two[:, 1:, 1:3]
    with np.errstate(divide="ignore", invalid="ignore"):
        now, was = moved / elapsed[:, :, None], stride / np.maximum(before, 1)
        speed, pace = np.linalg.norm(now, axis=2), np.linalg.norm(was, axis=1)[:, None]
        error = np.where(is_new, np.linalg.norm(moved, axis=2), np.linalg.norm(moved - stride[:, None], axis=2))
        allowed = np.minimum(limits.match_distance, limits.prediction_error + limits.error_per_gap * np.maximum(elapsed - 1, 0))
        change = np.linalg.norm(now - was[:, None], axis=2) / elapsed
        turn = np.degrees(np.arccos(np.clip((now * was[:, None]).sum(2) / (speed * pace), -1, 1)))
    possible = (elapsed > 0) & (speed >= limits.slowest) & (speed <= limits.fastest)
    steady = (error <= allowed) & (change <= limits.acceleration) & ~((pace > 0) & (speed > 0) & (turn > limits.turn))
    return np.where(possible & (is_new | steady), error, np.inf)


def best_pairs(errors: np.ndarray) -> dict[int, int]:
    """Column by row, the least errors first, each row and column once; of equal errors the first."""
    chosen: dict[int, int] = {}
    for flat in np.argsort(errors, axis=None, kind="stable")[: np.isfinite(errors).sum()]:
        row, column = divmod(int(flat), errors.shape[1])
        if np.isfinite(errors[row, column]):
            chosen[row] = column
            errors[row, :] = errors[:, column] = np.inf
    return chosen


@dataclass
class Tracker:
    """Tracks of one video; only live ones are held."""

    limits: TrackLimits = TrackLimits()
    live: list[Live] = field(default_factory=list)

    def update(self, frame: int, candidates: list[tuple[float, float, float]]) -> list[list[Point]]:
        """Link a frame's candidates (x, y, score), best pairs first, and return the confirmed tracks that end with it."""
        chosen: dict[int, int] = {}
        if self.live and candidates:
            places = np.array(candidates, float)[:, :2]
            chosen = best_pairs(link_errors([t.points for t in self.live], frame, places, self.limits))
        moved = [Live([*t.points, (frame, *candidates[chosen[i]])]) if i in chosen else Live(t.points, t.gap + 1) for i, t in enumerate(self.live)]
        seeds = [Live([(frame, *c)]) for j, c in enumerate(candidates) if j not in chosen.values()]
        over = [t for t in moved if t.gap > self.limits.max_gap]
        self.live = [t for t in moved if t.gap <= self.limits.max_gap] + seeds
        return self._confirmed(over)

    def _confirmed(self, tracks: list[Live]) -> list[list[Point]]:
        return [t.points for t in tracks if len(t.points) >= self.limits.confirmed_at]

    def finish(self) -> list[list[Point]]:
        """The confirmed tracks still live at the end."""
        over, self.live = self.live, []
        return self._confirmed(over)


def _by_frame(rows: pd.DataFrame) -> Iterator[tuple[int, list[tuple[float, float, float]]]]:
    for frame, own in rows.sort_values(["frame", "candidate"]).groupby("frame", sort=True):
        yield int(frame), list(zip(own["x"].astype(float), own["y"].astype(float), own["score"].astype(float), strict=True)) if own["x"].notna().all() else []


def _tracks_frame(video: str, first: int, tracks: list[list[Point]]) -> pd.DataFrame:
    points = [[dict(zip(("frame", "x", "y", "score"), p, strict=True)) for p in t] for t in tracks]
    return pd.DataFrame({"video_id": video, "track_no": pd.Series(range(first, first + len(tracks)), dtype="int32"), "points": points})


def track(candidates: DataFrame, limits: TrackLimits = TrackLimits()) -> DataFrame:
    """TRACKS of candidates(video_id, frame, candidate, x, y, score): one task a video.

    A frame without candidates is a row with null x; frames that are not there at all are taken as not seen.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tracker, found = Tracker(limits), []
        for frame, own in _by_frame(rows):
            found += tracker.update(frame, own)
        return _tracks_frame(key[0], 0, found + tracker.finish())

    return candidates.groupBy("video_id").applyInPandas(run, TRACKS)


class TrackProcessor(StatefulProcessor):
    """The tracker as a stateful stream operator keyed by video; a track is published when it ends."""

    def __init__(self, limits: TrackLimits = TrackLimits()):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        point = T.StructType([T.StructField("frame", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("x", "y", "score"))])
        live = T.StructType([T.StructField("gap", T.IntegerType()), T.StructField("points", T.ArrayType(point))])
        self.state = handle.getValueState("tracks", T.StructType([T.StructField("done", T.IntegerType()), T.StructField("live", T.ArrayType(live))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, live = self.state.get() if self.state.exists() else (0, [])
        tracker = Tracker(self.limits, [Live([tuple(p) for p in points], gap) for gap, points in live])
        found = []
        for frame, own in _by_frame(pd.concat(list(rows))):
            found += tracker.update(frame, own)
        self.state.update((done + len(found), [(t.gap, t.points) for t in tracker.live]))
        if found:
            yield _tracks_frame(key[0], done, found)

    def close(self) -> None:
        pass


def stream_tracks(candidates: DataFrame, limits: TrackLimits = TrackLimits()) -> DataFrame:
    """TRACKS as they end, of a stream of candidates in frame order."""
    return candidates.groupBy("video_id").transformWithStateInPandas(TrackProcessor(limits), outputStructType=TRACKS, outputMode="Append", timeMode="None")


@dataclass(frozen=True)
class Scene:
    """What a camera sees: rectangles (left, top, right, bottom), the table's polygon and the net's line; settings of F8 to F10 and W11."""

    launcher: tuple[float, float, float, float]
    returns: tuple[float, float, float, float]
    launch_points: int = 18
    launch_travel: float = 120
    launch_directness: float = 0.8
    return_travel: float = 120
    return_speed: float = 4
    return_points_after: int = 3

    @property
    def toward_player(self) -> int:
        """The sign of x from the launcher's rectangle to the returns'."""
        return 1 if self.returns[0] + self.returns[2] > self.launcher[0] + self.launcher[2] else -1


def track_measures(tracks: DataFrame) -> DataFrame:
    """tracks with n, first and last point, net and total horizontal travel, all by array functions."""
    points = F.col("points")
    xs = F.transform(points, lambda p: p["x"])
    steps = F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda b, a: b - a)
    total = F.aggregate(steps, F.lit(0.0), lambda t, d: t + F.abs(d))
    return tracks.withColumns({"n": F.size(points), "first": F.element_at(points, 1), "last": F.element_at(points, -1), "net_x": F.element_at(xs, -1) - F.element_at(xs, 1), "total_x": total})


def _inside(point: Column, box: tuple[float, float, float, float]) -> Column:
    return point["x"].between(box[0], box[2]) & point["y"].between(box[1], box[3])


def launch_reason(scene: Scene) -> Column:
    """Why a measured track is no launch; null if it is one."""
    toward = scene.toward_player * F.col("net_x")
    return (
        F.when(~_inside(F.col("first"), scene.launcher), "outside_launcher").when(F.col("n") < scene.launch_points, "too_short")
        .when(toward < scene.launch_travel, "insufficient_travel").when(toward < scene.launch_directness * F.col("total_x"), "indirect")
    )


def return_segments(tracks: DataFrame, scene: Scene) -> DataFrame:
    """tracks with segment: the points from the first one in the return rectangle that has enough travel toward the
    opponent after it; null if there is none."""
    away = -scene.toward_player
    numbered = F.transform("points", lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    ahead = lambda p: F.element_at("points", -1)["x"] * away - p["x"] * away
    first = F.try_element_at(F.filter(numbered, lambda s: _inside(s["p"], scene.returns) & (ahead(s["p"]) >= scene.return_travel)), F.lit(1))["i"]
    return tracks.withColumn("segment", F.when(first.isNotNull(), F.slice("points", first + 1, F.size("points") - first)))


def return_reason(scene: Scene, launch_frame: Column) -> Column:
    """Why a track with its segment is no return of the launch at launch_frame; null if it is one."""
    first, last = F.element_at("segment", 1), F.element_at("segment", -1)
    elapsed, gained = last["frame"] - first["frame"], (last["x"] - first["x"]) * -scene.toward_player
    later = F.size(F.filter("segment", lambda p: p["frame"] > launch_frame))
    return (
        F.when(~F.exists("points", lambda p: _inside(p, scene.returns)), "not_near_player").when(F.col("segment").isNull(), "no_travel_to_opponent")
        .when(launch_frame.isNull(), "no_launch").when((elapsed <= 0) | (F.try_divide(gained, elapsed) < scene.return_speed), "too_slow")
        .when(later < scene.return_points_after, "before_launch")
    )


def debounce(readings: DataFrame, samples: int = 2, speed_slack: float = 0.11, spin_slack: float = 1) -> DataFrame:
    """video_id, frame, speed, spin, label of each newly published screen state; null readings neither count nor reset.

    A reading is compared with the candidate that is held, not with its neighbour, so the state is sequential: one
    task a video.
    """

    slack = np.array([speed_slack, spin_slack])

    def alike(rows: pd.DataFrame, row: pd.Series) -> np.ndarray:
        close = np.abs(rows[["speed", "spin"]].to_numpy(float) - row[["speed", "spin"]].to_numpy(float)) <= slack
        return close.all(1) & (rows["label"] == row["label"]).to_numpy()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Runs of readings like their first one; from its `samples`-th on each may be published."""
        rest, published = rows.dropna(subset=["speed", "spin", "label"]).sort_values("frame"), []
        while len(rest):
            other = np.flatnonzero(~alike(rest, rest.iloc[0]))
            length = int(other[0]) if len(other) else len(rest)
            steady, rest = rest.iloc[samples - 1 : length], rest.iloc[length:]
            while len(steady):
                new = ~alike(steady, published[-1]) if published else np.ones(len(steady), bool)
                if not new.any():
                    break
                published.append(steady.iloc[int(new.argmax())])
                steady = steady.iloc[int(new.argmax()) + 1 :]
        found = pd.DataFrame(published, columns=rows.columns)
        return found.assign(video_id=key[0])[["video_id", "frame", "speed", "spin", "label"]]

    return readings.groupBy("video_id").applyInPandas(run, "video_id string, frame int, speed double, spin int, label string")


def readable(readings: DataFrame, every: int = 3) -> DataFrame:
    """readings(video_id, frame, speed, spin, label) of every third frame, with what cannot be true of a ball as not
    read: its speed, spin and label become null, so that it neither counts nor resets a debounced state."""
    sampled = readings.where(F.pmod("frame", F.lit(every)) == 0)
    known = scalars.plausible_reading(F.col("speed"), F.col("spin"))
    return sampled.withColumns({c: F.when(known, F.col(c)) for c in ("speed", "spin", "label")})


def latest_tracks(tracks: DataFrame, most: int = 8) -> DataFrame:
    """Of each video the tracks that ended last, as an overlay shows them; a track known by its first point twice is one."""
    once = tracks.withColumn("__key", scalars.track_key(F.element_at("points", 1))).dropDuplicates(["video_id", "__key"])
    order = Window.partitionBy("video_id").orderBy(F.element_at("points", -1)["frame"].desc(), F.col("track_no").desc())
    return once.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most).drop("__key", "__place")


def visible_points(tracks: DataFrame, last: int = 12) -> DataFrame:
    """tracks cut to the last points of each, as an overlay shows them."""
    return tracks.withColumn("points", F.slice("points", F.greatest(F.size("points") - last + 1, F.lit(1)), last))


def kinematics(tracks: DataFrame) -> DataFrame:
    """One row a point: velocity and acceleration from the points before it, for analysis."""
    order = Window.partitionBy("video_id", "track_no").orderBy("frame")
    rows = tracks.select("video_id", "track_no", F.explode("points").alias("p")).select("video_id", "track_no", "p.*")
    steps = F.col("frame") - F.lag("frame").over(order)
    moving = rows.withColumns({"vx": (F.col("x") - F.lag("x").over(order)) / steps, "vy": (F.col("y") - F.lag("y").over(order)) / steps, "__steps": steps})
    change = F.sqrt((F.col("vx") - F.lag("vx").over(order)) ** 2 + (F.col("vy") - F.lag("vy").over(order)) ** 2)
    return moving.withColumn("acceleration", change / F.col("__steps")).drop("__steps")
