"""Tracks to evidence to ledger, from synthetic paths alone."""

from rallyline.operators import tracking
from rallyline.operators.attempts import EVIDENCE, Camera, analyze, evidence, stream_evidence
from rallyline.plans.stream import drained
from rallyline.streaming.attempts import batch_ledger

POINTS = "array<struct<frame:int,x:double,y:double,score:double>>"
CAMERA = Camera(
    scene=tracking.Scene(launcher=(580.0, 0.0, 1000.0, 500.0), returns=(0.0, 0.0, 280.0, 500.0)),
    polygon=[(0.0, 0.0), (700.0, 0.0), (700.0, 300.0), (0.0, 300.0)], net_line=((350.0, 0.0), (350.0, 300.0)),
    matrix=[[0.01, 0.0, 0.0], [0.01, 0.0, -3.5], [0.0, 0.0, 1.0]],
)


def launch(frame):
    return [(frame + f, 800.0 - 10 * f, 100.0, 0.0) for f in range(18)]


def back(frame, bounces=True, reach=14):
    """A return from x = 100 at 40 pixels a frame; its turn, if any, is at x = 500, beyond the net."""
    return [(frame + f, 100.0 + 40 * f, 100.0 + (8 * min(f, 20 - f) if bounces else 0), 0.0) for f in range(reach)]


def test_tracks_become_evidence_in_order(spark):
    paths = [back(0), launch(10), back(30), launch(90), back(110, bounces=False, reach=20), launch(170), [(175, 0.0, 0.0, 0.0)] * 3]
    rows = [("v", i, p) for i, p in enumerate(paths)]
    found = evidence(spark.createDataFrame(rows, f"video_id string, track_no int, points {POINTS}"), CAMERA).orderBy("arrival").collect()
    assert [(r["kind"], r["frame"], r["outcome"]) for r in found] == [
        ("launch", 10, ""), ("event", 40, "far_table"), ("hit", 40, "far_table"), ("launch", 90, ""), ("non_hit", 129, "off_table"), ("launch", 170, ""),
    ]
    assert [r["confidence"] for r in found] == [0.0, 0.68, 0.68, 0.0, 0.58, 0.0]


def drill():
    paths = []
    for i in range(8):
        paths += [launch(10 + 80 * i), back(30 + 80 * i, bounces=i != 4, reach=14 if i != 4 else 20)]
    return paths


def test_stream_and_batch_give_the_same_evidence(spark, tmp_path):
    """Tracks that come a few at a time, with state between them."""
    paths = [back(0), *drill(), [(700, 0.0, 0.0, 0.0)] * 3]
    schema = f"video_id string, track_no int, points {POINTS}"
    rows = [(v, i, p) for v in "vw" for i, p in enumerate(paths)]
    for part in range(3):
        cut = [r for r in rows if r[1] * 3 // len(paths) == part]
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    key = lambda r: tuple(r[c] for c in EVIDENCE)
    streamed = sorted(map(key, drained(stream_evidence(stream, CAMERA)).collect()))
    assert streamed == sorted(map(key, evidence(spark.createDataFrame(rows, schema), CAMERA).collect())) and len(streamed) > 30


def test_candidates_become_upserts(spark):
    """The whole way in one plan: the ledger of a drill from its candidates."""
    spots = sorted({(f, x, y) for path in drill() for f, x, y, _ in path})
    numbered = [("v", f, sum(g == f for g, _, _ in spots[:k]), x, y, 0.0) for k, (f, x, y) in enumerate(spots)]
    gaps = [("v", f, 0, None, None, None) for f in range(spots[-1][0] + 40) if f not in {s[0] for s in spots}]
    frame = spark.createDataFrame(numbered + gaps, "video_id string, frame int, candidate int, x double, y double, score double")
    final = {r["sequence"]: r["outcome"] for r in analyze(frame, CAMERA).collect() if r["state"] == "finalized"}
    assert list(final.values())[:4] == ["hit"] * 4 and "miss" in final.values()


def test_a_drill_becomes_a_ledger(spark):
    paths = []
    for i in range(8):
        paths += [launch(10 + 80 * i), back(30 + 80 * i, bounces=i != 4, reach=14 if i != 4 else 20)]
    rows = spark.createDataFrame([("v", i, p) for i, p in enumerate(paths)], f"video_id string, track_no int, points {POINTS}")
    final = {r["sequence"]: r["outcome"] for r in batch_ledger(evidence(rows, CAMERA)).collect() if r["state"] == "finalized"}
    assert [final[i] for i in range(1, 8)] == ["hit", "hit", "hit", "hit", "miss", "hit", "hit"]
