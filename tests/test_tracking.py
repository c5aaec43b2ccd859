"""Tracks, launches, returns and bounces on synthetic paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyline.operators import bounces, tracking
from rallyline.operators.tracking import Scene, Tracker, TrackLimits

TABLE = [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)]
NET = ((500.0, 0.0), (500.0, 200.0))
POINTS = "array<struct<frame:int,x:double,y:double,score:double>>"


def path(n, x=lambda f: 10.0 * f, y=lambda f: 100.0, score=lambda f: 0.0):
    return [(f, float(x(f)), float(y(f)), float(score(f))) for f in range(n)]


def frame_of(spark, *paths):
    return spark.createDataFrame([("v", i, p) for i, p in enumerate(paths)], f"video_id string, track_no int, points {POINTS}")


def bounce(spark, points, **more):
    return bounces.find_bounces(frame_of(spark, points), TABLE, NET, **more).first()["bounce"]


def test_a_track_survives_a_short_gap_and_ends_after_a_long_one():
    tracker = Tracker()
    for f in (0, 1, 2, 6):
        assert tracker.update(f, [(10.0 * f, 100.0, 0.0)]) == []
    ended = [t for f in range(7, 14) for t in tracker.update(f, [])]
    assert [[p[0] for p in t] for t in ended] == [[0, 1, 2, 6]]


def test_unconfirmed_tracks_vanish():
    tracker = Tracker()
    tracker.update(0, [(0.0, 0.0, 0.0)])
    assert [t for f in range(1, 10) for t in tracker.update(f, [])] == [] and tracker.live == []


def test_the_nearest_prediction_wins_and_others_seed_tracks():
    tracker = Tracker()
    for f in range(3):
        tracker.update(f, [(10.0 * f, 50.0, 0.0)])
    tracker.update(3, [(31.0, 50.0, 0.0), (30.0, 50.0, 0.0)])
    assert tracker.live[0].points[-1][1] == 30.0 and len(tracker.live) == 2


@pytest.mark.parametrize("candidate", [(20.2, 50.0), (400.0, 50.0), (-80.0, 50.0)])
def test_impossible_steps_are_refused(candidate):
    points = [(0, 0.0, 50.0, 0.0), (1, 10.0, 50.0, 0.0), (2, 20.0, 50.0, 0.0)]
    errors = lambda frame, *places: tracking.link_errors([points], frame, np.array(places), TrackLimits()).tolist()
    assert errors(3, candidate, (30.0, 50.0)) == [[np.inf, 0.0]]
    assert errors(2, (30.0, 50.0)) == [[np.inf]]


def test_errors_of_all_pairs_at_once():
    """A new track's error is the distance; another's that from where its last stride leads; a turn back is refused."""
    tracks = [[(4, 0.0, 0.0, 0.0)], [(2, 0.0, 0.0, 0.0), (4, 20.0, 0.0, 0.0)], [(3, 100.0, 0.0, 0.0), (4, 110.0, 0.0, 0.0)]]
    errors = tracking.link_errors(tracks, 5, np.array([(30.0, 40.0), (90.0, 0.0)]), TrackLimits())
    assert errors[0].tolist() == [50.0, 90.0]
    assert errors[1].tolist() == [pytest.approx(np.hypot(10, 40)), pytest.approx(50.0)]
    assert errors[2].tolist() == [pytest.approx(np.hypot(90, 40)), np.inf]
    assert tracking.best_pairs(np.array([[3.0, 1.0], [1.0, np.inf], [2.0, 1.0]])) == {0: 1, 1: 0}


def test_settings_of_a_camera_override_known_names_only():
    assert TrackLimits().but(max_gap=9, nothing=1).max_gap == 9


def test_batch_and_stream_find_the_same_tracks(spark, tmp_path):
    from rallyline.plans.stream import drained

    rows = [("v", f, 0, 10.0 * f, 100.0, 0.0) for f in range(8)] + [("v", f, 1, 300.0 - 12 * f, 40.0, 1.0) for f in range(6)] + [("w", f, 0, 5.0 * f, 9.0, 0.0) for f in range(5)]
    rows += [(v, f, 0, None, None, None) for v in "vw" for f in range(8, 20)]
    schema = "video_id string, frame int, candidate int, x double, y double, score double"
    frame = spark.createDataFrame(rows, schema)
    frame.coalesce(1).write.json(str(tmp_path / "in"))
    key = lambda r: (r["video_id"], [tuple(p) for p in r["points"]])
    batch = sorted(map(key, tracking.track(frame).collect()))
    assert [len(p) for _, p in batch] == [8, 6, 5]
    assert sorted(map(key, drained(tracking.stream_tracks(spark.readStream.schema(schema).json(str(tmp_path / "in")))).collect())) == batch


SCENE = Scene(launcher=(580.0, 0.0, 1000.0, 500.0), returns=(0.0, 0.0, 280.0, 500.0))


def test_launch_reasons(spark):
    launch = path(18, lambda f: 800 - 10 * f)
    detour = path(40, lambda f: 800 - 10 * (f if f < 20 else 15 + (f - 20) % 7))
    measured = tracking.track_measures(frame_of(spark, launch, path(18), launch[:10], path(18, lambda f: 800 - f), detour))
    reasons = [r[0] for r in measured.orderBy("track_no").select(tracking.launch_reason(SCENE)).collect()]
    assert reasons[:4] == [None, "outside_launcher", "too_short", "insufficient_travel"] and reasons[4] in ("indirect", "insufficient_travel")


def test_return_reasons(spark):
    good = [(30 + f, 100.0 + 20 * f, 100.0, 0.0) for f in range(9)]
    late = [(20 - 9 + f, 100.0 + 20 * f, 100.0, 0.0) for f in range(9)]
    slow = [(30 + 9 * f, 100.0 + 20 * f, 100.0, 0.0) for f in range(9)]
    lead = [(20 + f, 290.0 - 19 * f, 100.0, 0.0) for f in range(10)] + good
    found = tracking.return_segments(frame_of(spark, good, late, slow, path(9, lambda f: 900 + f), lead), SCENE)
    rows = found.orderBy("track_no").select(tracking.return_reason(SCENE, F.lit(18)).alias("why"), F.size("segment").alias("n")).collect()
    assert [r["why"] for r in rows[:4]] == [None, "before_launch", "too_slow", "not_near_player"]
    still = [(30, 100.0, 100.0, 0.0)] * 3
    back = [(30 + f, 100.0 + 20 * f, 100.0, 0.0) for f in range(9)][:1] + [(30, 260.0, 100.0, 0.0)]  # no time goes by
    found = tracking.return_segments(frame_of(spark, still, back), SCENE).orderBy("track_no")
    assert [r["why"] for r in found.select(tracking.return_reason(SCENE, F.lit(18)).alias("why")).collect()] == ["no_travel_to_opponent", "too_slow"]
    assert rows[4]["why"] is None and rows[4]["n"] < len(lead)


def test_bounce_at_a_turn(spark):
    found = bounce(spark, path(11, lambda f: 10 * f, lambda f: 100 + 8 * min(f, 10 - f)))
    assert found["hit"]["frame"] == 5 and found["signal"] == "vertical_maximum"
    assert [p["frame"] for p in found["approach"]] == [2, 3, 4] and [p["frame"] for p in found["departure"]] == [6, 7]


def test_bounce_at_a_flattening(spark):
    found = bounce(spark, path(11, lambda f: 10 * f, lambda f: 15 * min(f, 5) + max(0, f - 5)))
    assert found["hit"]["frame"] == 5 and found["signal"] == "velocity_flattening"


def test_bounce_at_a_shadow_peak(spark):
    found = bounce(spark, path(11, score=lambda f: 40 if f == 6 else 0))
    assert found["hit"]["frame"] == 6 and found["signal"] == "shadow"
    last = path(11, score=lambda f: 40 if f == 10 else 0)
    assert bounce(spark, last)["signal"] == "terminal" and bounce(spark, last, allow_terminal=False) is None


@pytest.mark.parametrize("points", [path(8, y=lambda f: 100 + 8 * min(f, 7 - f)), path(11), path(11, lambda f: 400 + 10 * f, lambda f: 100 + 8 * min(f, 10 - f)), path(11, lambda f: 150 - 10 * f, lambda f: 100 + 8 * min(f, 10 - f)), path(11, lambda f: 10 * f if f < 7 else 20, lambda f: 100 + 8 * min(f, 10 - f))])
def test_no_bounce(spark, points):
    """Too short, straight, off the table, leftward, and turning back right after."""
    assert bounce(spark, points) is None


def test_outcome_without_a_bounce(spark):
    rows = [("v", 1, path(9, lambda f: 40 * f), True), ("v", 1, path(20, lambda f: 9 * f), False), ("v", 2, path(9, lambda f: 10 * f), True), ("v", 3, None, None)]
    found = bounces.non_bounce_outcome(spark.createDataFrame(rows, f"video_id string, attempt int, points {POINTS}, crossed_net boolean"), TABLE, NET)
    assert {r["attempt"]: (r["outcome"], r["confidence"]) for r in found.collect()} == {1: ("off_table", 0.58), 2: ("unknown", 0.5), 3: ("unknown", 0.2)}


def test_camera_regions(spark):
    rows = [("a", 1000, 500, 200.0, 300.0, 100.0, 900.0), ("b", 1000, 500, 100.0, 400.0, 900.0, 100.0), ("flat", 1000, 500, 100.0, 100.0, 100.0, 900.0)]
    found = {r["camera_id"]: r for r in bounces.camera_regions(spark.createDataFrame(rows, "camera_id string, width int, height int, table_top double, table_bottom double, player_x double, opponent_x double")).collect()}
    assert found["a"]["launcher_region"] == [580.0, 0.0, 999.0, 499.0] and found["a"]["return_region"] == [0.0, 0.0, 280.0, 499.0]
    assert found["a"]["tracking_region"] == [0.0, 50.0, 999.0, 350.0]
    assert found["b"]["launcher_region"] == [0.0, 0.0, 420.0, 499.0] and found["b"]["tracking_region"] == [0.0, 0.0, 999.0, 499.0]
    assert found["b"]["return_region"] == [720.0, 0.0, 999.0, 499.0] and found["flat"]["tracking_region"] == [0.0, 98.5, 999.0, 100.5]


def test_debounce(spark):
    values = [(10.0, 5, "up"), (10.1, 5, "up"), None, (12.0, 5, "up"), (10.05, 6, "up"), (12.0, 9, "left"), None, (12.1, 9, "left"), (12.0, 9, "left")]
    rows = [("v", i, *(v or (None, None, None))) for i, v in enumerate(values)]
    found = tracking.debounce(spark.createDataFrame(rows, "video_id string, frame int, speed double, spin int, label string")).collect()
    assert [(r["frame"], r["speed"]) for r in found] == [(1, 10.1), (7, 12.1)]


def test_visible_points(spark):
    found = tracking.visible_points(frame_of(spark, path(20), path(5))).orderBy("track_no").collect()
    assert [len(r["points"]) for r in found] == [12, 5] and found[0]["points"][0]["frame"] == 8


def test_kinematics(spark):
    rows = tracking.kinematics(frame_of(spark, path(4, lambda f: f * f))).orderBy("frame").collect()
    assert [r["vx"] for r in rows] == [None, 1.0, 3.0, 5.0] and rows[3]["acceleration"] == 2.0


def test_readings_that_cannot_be_are_not_read(spark):
    rows = [("v", 0, 12.0, 5, "up"), ("v", 1, 12.0, 5, "up"), ("v", 3, 120.0, 5, "up"), ("v", 6, 12.0, 151, "up"), ("v", 9, 12.0, 5, "up"), ("v", 12, None, None, None)]
    read = tracking.readable(spark.createDataFrame(rows, "video_id string, frame int, speed double, spin int, label string"))
    assert [(r["frame"], r["speed"], r["label"]) for r in read.orderBy("frame").collect()] == [(0, 12.0, "up"), (3, None, None), (6, None, None), (9, 12.0, "up"), (12, None, None)]
    assert [(r["frame"], r["spin"]) for r in tracking.debounce(read).collect()] == [(9, 5)]


def test_the_latest_tracks_of_a_video(spark):
    paths = [[(f + 3 * i, 10.0 * i, 5.0, 0.0) for f in range(4)] for i in range(10)]
    frame = frame_of(spark, *paths, paths[9][:2])
    found = {r["track_no"] for r in tracking.latest_tracks(frame).collect()}
    assert len(found) == 8 and set(range(3, 9)) <= found and len(found & {9, 10}) == 1
