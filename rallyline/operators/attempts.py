"""From finished tracks to the evidence that the attempt ledger reads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rallyline.functions import scalars
from rallyline.operators import tracking
from rallyline.operators.bounces import BounceLimits, find_bounces
from rallyline.streaming.attempts import batch_ledger

EVIDENCE = ("session", "arrival", "kind", "frame", "outcome", "confidence", "on_table")


@dataclass(frozen=True)
class Camera:
    """A calibrated view: scene, table polygon, net line, image-to-table matrix; z beyond far_side is the opponent's half."""

    scene: tracking.Scene
    polygon: list[tuple[float, float]]
    net_line: tuple[tuple[float, float], tuple[float, float]]
    matrix: list[list[float]]
    surface: float = 0.76
    far_side: float = 0.03


def _classified(tracks: DataFrame, camera: Camera, limits: BounceLimits) -> DataFrame:
    """tracks with what each is by itself: is_launch, launch_rows and, for one that may be a return, return_rows of
    evidence, null if it can't be. Whether a return belongs to a launch is left open."""
    measured = tracking.return_segments(tracking.track_measures(tracks), camera.scene)
    measured = measured.withColumn("is_launch", tracking.launch_reason(camera.scene).isNull())
    measured = measured.withColumn("may_return", ~F.col("is_launch") & tracking.return_reason(camera.scene, F.lit(-1)).isNull())
    found = find_bounces(measured.withColumn("points", F.coalesce("segment", "points")), camera.polygon, camera.net_line, limits)
    b, last = F.col("bounce"), F.col("last")
    place = scalars.table_point(b["hit"]["x"], b["hit"]["y"], camera.matrix, camera.surface)
    far = place["z"] > camera.far_side
    continuity = F.least(F.lit(1.0), (F.size(b["approach"]) + F.size(b["departure"])) / 6)
    off = ~scalars.in_polygon(last["x"], last["y"], camera.polygon)
    one = lambda kind, frame, outcome, confidence, on_table: F.struct(F.lit(kind).alias("kind"), frame.cast("long").alias("frame"), outcome.alias("outcome"), confidence.cast("double").alias("confidence"), on_table.alias("on_table"))
    launch = one("launch", F.col("first.frame"), F.lit(""), F.lit(0.0), F.lit(False))
    contact = [F.when(far, "far_table").otherwise("near_table"), scalars.attempt_confidence(F.when(far, 0.82).otherwise(0.72), continuity, F.lit(1.0)), F.lit(True)]
    seen, hit = (one(kind, b["hit"]["frame"], *contact) for kind in ("event", "hit"))
    missed = one("non_hit", last["frame"], F.when(off, "off_table").otherwise("unknown"), F.when(off, 0.58).otherwise(0.35), F.lit(False))
    rows = F.when(b.isNull(), F.array(missed)).when(far, F.array(seen, hit)).otherwise(F.array(seen))
    return found.select(
        "video_id", "track_no", F.col("last.frame").alias("ended"), "is_launch", F.col("first.frame").alias("launch_at"),
        F.when(F.col("is_launch"), F.array(launch)).when(F.col("may_return"), rows).alias("rows"), F.transform("segment", lambda p: p["frame"]).alias("frames"),
    )


def evidence(tracks: DataFrame, camera: Camera, limits: BounceLimits = BounceLimits()) -> DataFrame:
    """EVIDENCE of TRACKS, in the order in which a video's tracks end.

    A launch closes the attempt before it. A track after a launch that is a return gives its bounce, a hit if that is
    on the far side; a return without one is held as a provisional non-hit. Other tracks give nothing. Attempts are
    numbered by a window over launches, so no state is kept; a video is one partition of that window.
    """
    order = Window.partitionBy("video_id").orderBy("ended", "track_no")
    launch = F.last(F.when(F.col("is_launch"), F.col("launch_at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    known = _classified(tracks, camera, limits).withColumn("launch_frame", launch)
    later = F.size(F.filter("frames", lambda f: f > F.col("launch_frame")))
    used = known.where(F.col("rows").isNotNull() & (F.col("is_launch") | (later >= camera.scene.return_points_after)))
    listed = used.withColumn("arrival", F.row_number().over(order).cast("long")).select(F.col("video_id").alias("session"), "arrival", F.posexplode("rows").alias("part", "e"))
    return listed.select("session", (F.col("arrival") * 2 + F.col("part")).alias("arrival"), "e.*")


STREAMED = "session string, arrival long, kind string, frame long, outcome string, confidence double, on_table boolean"


class AttemptProcessor(StatefulProcessor):
    """The life of attempts on a stream of classified tracks: the state is the launch that is open and how many tracks
    were used. A launch closes the attempt before it at once; a return passes if enough of it is later than the launch."""

    def __init__(self, points_after: int):
        self.points_after = points_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", T.StructType([T.StructField("launch", T.IntegerType()), T.StructField("used", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        launch, used = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values(["ended", "track_no"]).itertuples(index=False):
            if row.rows is None:
                continue
            if row.is_launch:
                launch = int(row.launch_at)
            elif launch is None or sum(f > launch for f in row.frames) < self.points_after:
                continue
            used += 1
            out += [(key[0], 2 * used + part, *(e[c] for c in EVIDENCE[2:])) for part, e in enumerate(row.rows)]
        self.state.update((launch, used))
        if out:
            yield pd.DataFrame(out, columns=list(EVIDENCE))

    def close(self) -> None:
        pass


def stream_evidence(tracks: DataFrame, camera: Camera, limits: BounceLimits = BounceLimits()) -> DataFrame:
    """EVIDENCE of a stream of TRACKS that come as they end, as evidence() gives it of all together."""
    processor = AttemptProcessor(camera.scene.return_points_after)
    keyed = _classified(tracks, camera, limits).groupBy("video_id")
    return keyed.transformWithStateInPandas(processor, outputStructType=STREAMED, outputMode="Append", timeMode="None")


def analyze(candidates: DataFrame, camera: Camera, limits: BounceLimits = BounceLimits(), fps: float = 60.0) -> DataFrame:
    """Upserts of the attempts in candidates(video_id, frame, candidate, x, y, score): tracks, evidence and ledger in one
    plan, keyed by video throughout."""
    return batch_ledger(evidence(tracking.track(candidates), camera, limits), fps)
