"""Records and frames in and out, on files made here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyline.operators import tracking
from rallyline.sources import frames, records


def test_jsonl_round_trip_leaves_out_nulls_but_positions(spark, tmp_path):
    rows = [(1.5, "hit", None, 0.76, None, None), (2.5, "miss", 0.1, 0.2, 0.3, 7)]
    table = spark.createDataFrame(rows, "video_time_seconds double, outcome string, posx double, posy double, posz double, attempt_frame_number int")
    records.write_jsonl(table.coalesce(1), str(tmp_path / "out"))
    lines = sorted(line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [
        {"video_time_seconds": 1.5, "outcome": "hit", "posx": None, "posy": 0.76, "posz": None},
        {"video_time_seconds": 2.5, "outcome": "miss", "posx": 0.1, "posy": 0.2, "posz": 0.3, "attempt_frame_number": 7},
    ]
    back = records.read_jsonl(spark, str(tmp_path / "out"), records.BOUNCE_EVENTS)
    assert {(r["outcome"], r["attempt_frame_number"]) for r in back.collect()} == {("hit", None), ("miss", 7)}
    assert records.read_jsonl(spark, None, records.UPSERTS).count() == 0


def test_blank_and_broken_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"attempt_id": "a"}\n\n{"attempt_id": "b"}\n')
    assert records.read_jsonl(spark, str(tmp_path / "a.jsonl"), records.UPSERTS).count() == 2
    lines = spark.createDataFrame([('{"attempt_id": "a", "sequence": 1}',), ("starting up",), ("[1]",), ('{"attempt_id": ',), ("",)], "value string")
    assert [r["attempt_id"] for r in records.parse_lines(lines, "value", records.UPSERTS).collect()] == ["a"]


def test_labels_are_checked_sorted_and_stored(spark, tmp_path):
    rows = spark.createDataFrame([(0, 2.00049, "miss"), (1, 1.0, "hit")], "label_no int, time_seconds double, outcome string")
    records.save_labels(rows, str(tmp_path / "labels"))
    back = records.read_labels(spark, str(tmp_path / "labels"))
    assert [(r["time_seconds"], r["outcome"]) for r in back.orderBy("label_no").collect()] == [(1.0, "hit"), (2.0, "miss")]
    for bad in ((0, -1.0, "hit"), (0, None, "hit"), (0, 1.0, "out"), (0, float("nan"), "hit")):
        with pytest.raises(Exception, match="label is not valid"):
            records.stored_labels(spark.createDataFrame([bad], rows.schema)).collect()


CORNERS = [{"name": n, "image": i, "log": g} for n, i, g in (("a", [0, 0], [0, 0.76, 0]), ("b", [100, 0], [1, 0.76, 0]), ("c", [100, 50], [1, 0.76, 2]), ("d", [0, 50], [0, 0.76, 2]))]


def test_calibration(spark, tmp_path):
    whole = {"image_size": [100, 50], "table_surface_y": 0.76, "control_points": CORNERS, "table_polygon": [[0, 0], [100, 0], [100, 50], [0, 50]], "net_line": [[50, 0], [50, 50]]}
    (tmp_path / "good.json").write_text(json.dumps(whole, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps({k: v for k, v in whole.items() if k != "net_line"}))
    good = records.read_calibration(spark, str(tmp_path / "good.json")).first()
    assert good["table_surface_y"] == 0.76 and good["launcher_region"] is None
    matrix = np.array(records.homography(whole))
    x, z, w = matrix @ [50, 25, 1]
    assert (x / w, z / w) == (pytest.approx(0.5), pytest.approx(1.0))
    with pytest.raises(Exception, match="calibration"):
        records.read_calibration(spark, str(tmp_path / "bad.json")).collect()


def test_subscribers_resume(spark):
    events = spark.createDataFrame([("s", i) for i in range(1, 5)] + [("t", 9)], "session string, event_id long")
    assert [r["event_id"] for r in records.published_after(events, "s", "s:2").collect()] == [3, 4]
    assert records.published_after(events, "s", "t:2").count() == records.published_after(events, "s", None).count() == 4


def test_replay_takes_a_file_a_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text(json.dumps({"attempt_id": f"a{i}"}) + "\n")
    running = records.replay(spark, str(tmp_path), records.UPSERTS).writeStream.format("memory").queryName("replayed").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("replayed").count() == 3 and sum(p["numInputRows"] > 0 for p in running.recentProgress) == 3


@pytest.mark.parametrize(("stored", "wanted"), [("5", 5), ("-1", 0), ("x", 0), (None, 0), ("", 0)])
def test_stored_streaks(spark, stored, wanted):
    assert spark.createDataFrame([(stored,)], "v string").select(records.stored_streak(F.col("v")).alias("n")).first()["n"] == wanted


def test_lines_and_reports(spark, tmp_path):
    row = spark.createDataFrame([("wrong", None, "hit")], "k string, e string, a string")
    assert row.select(records.mismatch_line(F.col("k"), F.col("e"), F.col("a")).alias("l")).first()["l"] == "wrong: expected -, got hit"
    report = spark.createDataFrame([(3, 0.5)], "match int, accuracy double")
    records.write_json_document(report, str(tmp_path / "r"))
    assert records.as_dict(report) == {"match": 3, "accuracy": 0.5}
    assert records.report_markdown(records.as_dict(report)).splitlines()[2:] == ["| match | 3 |", "| accuracy | 0.5000 |"]


@pytest.fixture(scope="module")
def video(tmp_path_factory):
    """Forty frames of a white ball that moves five pixels a frame over a green table."""
    stack = np.zeros((40, 60, 260, 3), np.uint8)
    stack[:, :, :] = (60, 120, 40)
    for f in range(40):
        stack[f, 28:33, 10 + 5 * f : 15 + 5 * f] = 250
    path = tmp_path_factory.mktemp("video") / "v.npy"
    np.save(path, stack)
    return str(path)


def test_frames_are_read_in_runs_and_ranges(spark, video):
    every = frames.open_frames(spark, video, frames_per_partition=16)
    assert every.count() == 40 and every.rdd.getNumPartitions() == 3
    part = frames.open_frames(spark, video, start_seconds=0.1, end_seconds=0.5)
    assert sorted(r["frame_no"] for r in part.select("frame_no").collect()) == list(range(6, 30))
    assert frames.bounded(every, 0.1, 0.5).count() == 24


def test_live_frames(spark, video):
    stream = frames.open_frames(spark, video, live=True, frames_per_batch=16).select("frame_no")
    running = stream.writeStream.format("memory").queryName("live_frames").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(r["frame_no"] for r in spark.table("live_frames").collect()) == list(range(40))


CORRIDOR = (0.0, 0.0, 260.0, 60.0)


def test_a_moving_ball_becomes_one_track(spark, video):
    found = frames.candidates(frames.open_frames(spark, video), CORRIDOR)
    good = found.where("rejected is null")
    assert good.count() == 39 and {round(r["y"]) for r in good.collect()} == {30}
    tracks = tracking.track(good.select("video_id", "frame", "candidate", "x", "y", "score")).collect()
    assert [len(t["points"]) for t in tracks] == [39]


def painted(paint):
    before = np.zeros((60, 260, 3), np.uint8)
    after = before.copy()
    paint(after)
    return frames.blobs(before, after, CORRIDOR)


def fill(y, x, h, w, color=(250, 250, 250)):
    def paint(image):
        image[y : y + h, x : x + w] = color

    return paint


@pytest.mark.parametrize(("paint", "why"), [(fill(20, 20, 5, 5), None), (fill(20, 20, 1, 1), "area"), (fill(20, 20, 2, 9), "aspect"), (fill(20, 20, 5, 5, (0, 0, 250)), "saturation"), (fill(5, 20, 40, 40), "area")])
def test_blob_filters(paint, why):
    assert [b[4] for b in painted(paint)] == [why]


def test_blobs_outside_still_and_diagonal():
    assert frames.blobs(None, np.zeros((4, 4, 3), np.uint8), CORRIDOR) == []
    assert painted(lambda image: None) == []
    assert [b[4] for b in frames.blobs(np.zeros((60, 260, 3), np.uint8), _one(fill(20, 20, 5, 5)), (100.0, 0.0, 260.0, 60.0))] == ["region"]
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 1, 0]], bool)
    assert frames.label_components(mask).max() == 1
    assert frames.label_components(np.array([[1, 0, 1]], bool)).tolist() == [[1, 0, 2]]
    assert frames.label_components(np.ones((2, 2), bool)).tolist() == [[1, 1], [1, 1]]


def _one(paint):
    image = np.zeros((60, 260, 3), np.uint8)
    paint(image)
    return image


def test_shadow_score_and_spin_axis():
    table = np.full((80, 80, 3), 0, np.uint8)
    table[:, :] = (40, 120, 40)
    assert frames.shadow_score(table, 40, 30) == 0.0
    table[36:50, 34:47] = (20, 60, 20)
    assert frames.shadow_score(table, 40, 30) == pytest.approx(60, abs=1)
    arrow = np.zeros((30, 30), bool)
    arrow[15, 3:25] = True
    arrow[12:19, 22:25] = True
    x, y = frames.spin_axis(arrow)
    assert x > 0.95 and abs(y) < 0.2
    assert frames.spin_axis(np.zeros((3, 3), bool)) is None


def test_bounce_diagnostics_and_calibrations_are_written(spark, tmp_path):
    rows = [(7, "confirmed_bounce", "turn hit_frame=7", [[7.0, 1.0, 2.0]]), (8, "rejected", "no", [])]
    frame = spark.createDataFrame(rows, "draw_frame int, kind string, reason string, points array<array<double>>")
    records.write_bounce_diagnostics(frame, str(tmp_path / "bounces"))
    assert [r["draw_frame"] for r in spark.read.json(str(tmp_path / "bounces")).collect()] == [7]
    reviews = spark.createDataFrame([(2, "extra"), (1, "missing")], "review_number int, kind string")
    records.write_review_manifest(reviews, {"match": 3, "accuracy": 0.75}, ["overlap", "handoff"], str(tmp_path / "reviews"))
    found = json.loads(spark.read.text(str(tmp_path / "reviews"), wholetext=True).first()[0])
    assert found["categories"] == ["overlap", "handoff"] and found["scorecard"] == {"match": 3, "accuracy": 0.75}
    assert found["reviews"] == [{"review_number": n, "kind": k, "category": None, "review_notes": ""} for n, k in ((1, "missing"), (2, "extra"))]


def test_a_calibration_survives_writing_and_reading(spark, tmp_path):
    points = [{"name": str(k), "image": [float(k % 2), float(k // 2)], "log": [float(k % 2), 0.76, float(k // 2)]} for k in range(4)]
    whole = {name: [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]] for name in ("table_polygon", "net_line", "tracking_polygon", "table_contact_polygon", "occlusion_polygon")}
    whole |= {"description": "x", "image_size": [2, 2], "table_surface_y": 0.76, "control_points": points, "launcher_region": [0.0, 0.0, 1.0, 1.0], "return_region": [0.0, 0.0, 1.0, 1.0]}
    frame = spark.read.schema(records.CALIBRATION).json(spark.sparkContext.parallelize([json.dumps(whole)]))
    records.write_calibration(frame, str(tmp_path / "out"))
    assert records.read_calibration(spark, str(tmp_path / "out")).drop("detector_settings").collect() == frame.drop("detector_settings").collect()
    with pytest.raises(Exception, match="control points"):
        records.write_calibration(frame.withColumn("control_points", F.slice("control_points", 1, 3)), str(tmp_path / "bad"))


def test_events_are_appended_once_across_restarts(spark, tmp_path):
    schema = "session string, event_id int"
    place = {name: str(tmp_path / name) for name in ("in", "out", "state")}
    for batch in ([("a", 1), ("a", 2)], [("a", 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(place["in"])
        query = records.append_events(spark.readStream.schema(schema).json(place["in"]), place["out"], place["state"])
        query.processAllAvailable()
        query.stop()
    assert sorted(r["event_id"] for r in spark.read.schema(schema).json(place["out"]).collect()) == [1, 2, 3]
