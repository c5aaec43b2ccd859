"""Ledger, nearness in time, cadence, metrics, evaluation and scalar functions on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from rallyline.functions import scalars
from rallyline.operators import cadence, evaluation, ledger, metrics, temporal


def column(spark, expression, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    row = spark.createDataFrame([tuple(v for _, v in values.values())], names) if values else spark.range(1)
    return row.select(expression.alias("v")).first()["v"]


def outcomes(spark, text):
    return spark.createDataFrame([("u", i, o) for i, o in enumerate(text.split())], "k string, sequence int, outcome string")


@pytest.mark.parametrize(("text", "streaks", "best"), [("miss hit miss hit hit miss out hit", [0, 1, 0, 1, 2, 0, 0, 1], 2), ("hit hit hit miss hit hit hit", [1, 2, 3, 0, 1, 2, 3], 3)])
def test_streaks(spark, text, streaks, best):
    rows = ledger.running_best(ledger.hit_streak(outcomes(spark, text), ["k"], ["sequence"], F.col("outcome") == "hit"), ["k"], ["sequence"]).orderBy("sequence").collect()
    assert [r["streak"] for r in rows] == streaks and rows[-1]["best"] == best


def test_first_final_row_wins_for_ever(spark):
    rows = [("a", 1, "pending", None), ("a", 2, "finalized", "hit"), ("a", 3, "finalized", "miss"), ("a", 4, "pending", None), ("b", 5, "pending", "x"), ("b", 6, "pending", "y")]
    merged = ledger.merge_upserts(spark.createDataFrame(rows, "id string, n int, state string, outcome string"), ["id"], ["n"], F.col("state") == "finalized")
    assert {r["id"]: (r["n"], r["outcome"]) for r in merged.collect()} == {"a": (2, "hit"), "b": (6, "y")}


def test_streak_by_arrival(spark):
    rows = [("u", 1, 10, True), ("u", 2, 30, True), ("u", 3, 20, False), ("u", 4, 40, True)]
    found = ledger.arrival_streak(spark.createDataFrame(rows, "k string, n int, t int, hit boolean"), ["k"], "n", "t", F.col("hit"))
    assert [r["streak"] for r in found.orderBy("n").collect()] == [1, 2, 1, 2]


def test_replay_mismatches(spark):
    expected = spark.createDataFrame([("v", 1, "hit"), ("v", 2, "miss"), ("v", 3, "hit")], "video string, sequence int, outcome string")
    actual = spark.createDataFrame([("v", 1, "a1", 60, "hit", 1.0), ("v", 2, "a2", 60, "hit", 9.0)], "video string, sequence int, attempt_id string, anchor_frame_number int, outcome string, delay double")
    limits = spark.createDataFrame([("hit", 5.5), ("miss", 3.0)], "outcome string, limit double")
    found = sorted((r["check"], r["detail"]) for r in ledger.replay_mismatches(expected, actual, limits).collect())
    assert found == [("late", "a2 after 9.000 s"), ("length", "3 expected, 2 published"), ("outcome", "#2: expected miss, got hit"), ("outcome", "#3: expected hit, got -"), ("same_frame", "60 occurs 2 times")]


def test_publication_delays(spark):
    rows = [("a", "finalized", 100, 130, 250), ("b", "finalized", 100, None, 250), ("c", "pending", 100, None, 250)]
    found = ledger.with_publication(spark.createDataFrame(rows, "id string, state string, anchor_frame_number int, frame_number int, now int"), F.col("now"))
    assert {r["id"]: (r["publication_delay_frames"], r["publication_delay_seconds"], r["attempt_publication_delay_seconds"]) for r in found.collect()} == {
        "a": (120, 2.0, 2.5), "b": (150, 2.5, 2.5), "c": (None, None, None),
    }


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 25), ("a", 3, 5), ("b", 4, 10), ("c", 5, 10)], "k string, id int, t int")
    right = spark.createDataFrame([("a", "p", 8), ("a", "q", 10), ("a", "r", 29), ("b", "s", 15)], "k string, name string, rt int")
    return left, right


def test_asof_backward(sides):
    found = {r["id"]: [m["name"] for m in r["matches"] or []] for r in temporal.asof_backward(*sides, ["k"], "t", "rt", k=2).collect()}
    assert found == {1: ["q", "p"], 2: ["q", "p"], 3: [], 4: [], 5: []}


def test_nearest_within(sides):
    found = {r["id"]: r["match"] and r["match"]["name"] for r in temporal.nearest_within(*sides, ["k"], "t", "rt", F.lit(4)).collect()}
    assert found == {1: "q", 2: "r", 3: "p", 4: None, 5: None}


def test_interval_join_across_cells(sides):
    found = sorted((r["id"], r["name"]) for r in temporal.interval_join(*sides, ["k"], "t", "rt", 5).collect())
    assert found == [(1, "p"), (1, "q"), (2, "r"), (3, "p"), (3, "q"), (4, "s")]


def test_reconnect_takes_the_smallest_gap(spark):
    ends = spark.createDataFrame([("v", 1, 10, 100.0), ("v", 2, 18, 130.0), ("v", 3, 19, 900.0)], "k string, end_id int, end_t int, end_x double")
    starts = spark.createDataFrame([("v", 9, 20, 150.0), ("v", 8, 60, 150.0)], "k string, start_id int, start_t int, start_x double")
    found = temporal.reconnect(ends, starts, ["k"], 24, (-20.0, 320.0), 50.0).collect()
    assert [(r["start_id"], r["end_id"]) for r in found] == [(9, 2)]


def test_a_slot_keeps_its_nearest_then_strongest_hit(spark):
    hits = spark.createDataFrame([("v", 1, 58, 0.5), ("v", 2, 62, 0.9), ("v", 3, 125, 0.5)], "k string, h int, t int, c double")
    slots = spark.createDataFrame([("v", 60), ("v", 120)], "k string, anchor int")
    found = temporal.nearest_slot(hits, slots, ["k"], "t", "anchor", F.lit(18), "c", "h").collect()
    assert sorted((r["match"]["anchor"], r["h"]) for r in found) == [(60, 2), (120, 3)]


def test_cadence_fills_empty_slots(spark):
    hits = spark.createDataFrame([("v", float(t), 0.8) for t in (70, 190, 250)], "k string, t double, confidence double")
    grid = cadence.period_grid(60.0, 132.0, 0.1)
    fitted = cadence.fit_phase(hits, cadence.fit_period(hits, ["k"], "t", grid), ["k"], "t")
    slots = cadence.slots(fitted, hits, ["k"], "t", F.lit(300.0))
    met = temporal.nearest_slot(hits.withColumn("h", F.lit(0)), slots, ["k"], "t", "anchor", F.lit(18.0), "confidence", "h")
    filled = cadence.fill(slots, met.select("k", F.col("match.slot").alias("slot"), F.lit("hit").alias("outcome"), "confidence"), ["k"])
    assert [r["outcome"] for r in filled.orderBy("slot").collect()][:4] == ["hit", "miss", "hit", "hit"]


@pytest.mark.parametrize(("expected", "actual", "kinds"), [
    ("hmhh", "hmh", {"match": 3, "missing": 1}), ("hmh", "hmhh", {"match": 3, "extra": 1}), ("hm", "mh", {"wrong_outcome": 2}), ("", "", {}), ("", "h", {"extra": 1}),
])
def test_alignment(expected, actual, kinds):
    items = evaluation.align(list(expected), list(actual))
    found = {}
    for kind, i, j in items:
        found[kind] = found.get(kind, 0) + 1
        assert (i is None) == (kind == "extra") and (j is None) == (kind == "missing")
    assert found == kinds


def test_evaluation_end_to_end(spark):
    """Two recordings; one has a missed hit and an extra one, the other nothing at all on one side."""
    schema = "video string, place long, outcome string, time_seconds double"
    labels = spark.createDataFrame([("v", i, o, i * 1.3) for i, o in enumerate(["hit", "miss", "hit", "hit"])] + [("w", 0, "miss", 0.0)], schema)
    guesses = spark.createDataFrame([("v", i, o, i * 78) for i, o in enumerate(["hit", "hit", "hit"])], "video string, place long, outcome string, frame long")
    aligned = evaluation.align_by(evaluation.assert_resolved(labels), guesses, "video", "place", "outcome")
    counts = {r["video"]: r.asDict() for r in evaluation.sequence_counts(aligned, "video").collect()}
    assert (counts["v"]["match"], counts["v"]["wrong_outcome"] + counts["v"]["missing"], counts["v"]["accuracy"]) == (3, 1, 0.75)
    assert counts["w"]["missing"] == 1
    pairs = evaluation.hit_pairs(aligned, labels, guesses, "video")
    rated = {r["video"]: r.asDict() for r in evaluation.confusion(pairs, F.col("truth"), F.col("guess"), "video").collect()}
    assert rated["v"]["true_hit"] == 3 and rated["v"]["precision"] == 1.0 and "w" not in rated
    errors = evaluation.error_rows(aligned, labels, guesses, "video")
    diagnostics = spark.createDataFrame([("v", "shadow hit_frame=80", [[70.0, 1.0], [79.0, 2.0]]), ("v", "turn", [[9000.0, 1.0]]), ("v", "none", [])], "video string, reason string, points array<array<double>>")
    manifest = {(r["video"], r["review_number"]): r for r in evaluation.review_manifest(errors, diagnostics, "video").collect()}
    assert manifest["v", 1]["anchor_time_seconds"] == 1.3 and manifest["v", 1]["clip_start_seconds"] == 0.0
    assert manifest["v", 1]["raw_clip"].startswith("raw/01-missing-expected-2")
    assert [(d["hit_frame"], d["signal"], d["track_start_frame"]) for d in manifest["v", 1]["nearby_bounce_diagnostics"]] == [(80, "shadow", 70)]


def test_unresolved_labels_stop_the_evaluation(spark):
    with pytest.raises(Exception, match="unresolved"):
        evaluation.assert_resolved(spark.createDataFrame([("uncertain",)], "outcome string")).collect()


def test_metrics(spark):
    rows = spark.createDataFrame([(0.0,), (None,), (float("nan"),), (4.0,), (2.0,)], "x double")
    assert rows.agg(metrics.truthy_mean("x").alias("m")).first()["m"] == 3.0
    assert rows.where("x = 99").agg(metrics.truthy_mean("x").alias("m"), metrics.percentage(F.lit(True), F.lit(True)).alias("p")).first().asDict() == {"m": None, "p": None}
    week = rows.limit(1).select(metrics.week_start(F.to_date(F.lit("2026-07-21"))).alias("w"), metrics.week_start(F.to_date(F.lit("2026-07-19"))).alias("s")).first()
    assert str(week["w"]) == str(week["s"]) == "2026-07-19"
    cells = metrics.heatmap(spark.createDataFrame([(0.0, 0.0), (0.001, 0.001), (5.0, 0.0)], "x double, z double"), F.col("x"), F.col("z")).collect()
    assert [(r["gx"], r["gz"], r["n"], r["most"]) for r in cells] == [(200, 350, 2, 2)]
    dated = spark.sql("SELECT timestamp_ntz'2026-07-20 12:00:00' AS t UNION ALL SELECT timestamp_ntz'2026-07-01 12:00:00'")
    assert metrics.last_days(dated, "t", "2026-07-21 00:00:00").count() == 1


@pytest.mark.parametrize(("serving", "kinds", "fault"), [
    (True, "MyToss", False), (True, "MyToss MyHit", True), (True, "MyToss MyHit MyTable TheirTable", False), (True, "MyToss MyHit MyTable Net TheirTable", False),
    (True, "MyToss MyHit MyTable Net", True), (True, "MyHit MyTable TheirTable", True), (True, "MyToss MyHit Net MyTable", True),
    (False, "TheirHit", False), (False, "TheirHit TheirTable MyTable", False), (False, "TheirHit TheirTable", True), (False, "TheirHit Net MyTable", True),
])
def test_service_faults(spark, serving, kinds, fault):
    assert column(spark, scalars.service_fault(F.col("k"), F.col("s")), k=("array<string>", kinds.split()), s=("boolean", serving)) is fault


@pytest.mark.parametrize(("scores", "before", "first", "won"), [
    ([[1, 0]], None, True, True), ([[1, 0]], None, False, False), ([[0, 1]], None, False, True), ([[0, 0]], None, True, False),
    ([], [[11, 9]], True, True), ([], [[9, 11]], True, False), ([], [[9, 9]], True, False), ([[5, 3]], [[4, 3]], True, True), ([[4, 4]], [[4, 3]], True, False),
])
def test_points_won(spark, scores, before, first, won):
    kind = "array<array<int>>"
    assert column(spark, scalars.point_won(F.col("s"), F.col("b"), F.col("f")), s=(kind, scores), b=(kind, before), f=("boolean", first)) is won


def test_text_functions(spark):
    assert column(spark, scalars.first_replaced(F.lit("pos: a pos: b"), "pos:", "position:")) == "position: a pos: b"
    assert column(spark, scalars.first_replaced(F.lit("none"), "pos:", "position:")) == "none"
    assert column(spark, scalars.first_pieces(F.lit("a-b-c"), "-", 2)) == ["a", "b"]
    assert column(spark, scalars.pieces_after(F.lit("x(.)y(.)z"), "(.)")) == ["y", "z"] and column(spark, scalars.pieces_after(F.lit("x"), "(.)")) == []
    assert column(spark, scalars.clock(F.lit(65.4321))) == "01:05.432"
    assert column(spark, scalars.attempt_name(F.lit(7))) == "attempt-0007"
    assert [column(spark, scalars.resume_index(F.lit(t), "s")) for t in ("s:12", "t:12", "s:x", "s:-3", None)] == [12, 0, 0, 0, 0]


@pytest.mark.parametrize(("header", "wanted"), [(None, (0, 99)), ("bytes=10-19", (10, 19)), ("bytes=90-", (90, 99)), ("bytes=-5", (95, 99)), ("bytes=50-500", (50, 99)), ("bytes=100-", None), ("bytes=-0", None), ("bytes=9-3", None), ("lines=1-2", None), ("bytes=1-2,4-5", None)])
def test_byte_ranges(spark, header, wanted):
    found = column(spark, scalars.byte_range(F.col("h"), F.lit(100)), h=("string", header))
    assert (found and tuple(found)) == wanted


def test_geometry(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    point = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    assert [column(spark, scalars.in_polygon(*point(x, y), square)) for x, y in ((5, 5), (15, 5), (-1, 5), (10, 5), (0, 0))] == [True, False, False, True, True]
    assert column(spark, scalars.near_polygon(*point(14, 5), square, 4)) and not column(spark, scalars.near_polygon(*point(15, 5), square, 4))
    assert column(spark, scalars.line_side(*point(3, 4), ((0.0, 0.0), (10.0, 0.0)))) == 4.0
    assert column(spark, scalars.line_x(F.lit(5.0), ((0.0, 0.0), (10.0, 10.0)))) == 5.0 and column(spark, scalars.line_x(F.lit(5.0), ((0.0, 1.0), (10.0, 1.0)))) is None
    found = column(spark, scalars.table_point(*point(3, 4), [[2, 0, 1], [0, 3, 0], [0, 0, 2]], 0.76))
    assert (found["x"], found["y"], found["z"]) == (3.5, 0.76, 6.0)
    assert [column(spark, scalars.octant(F.lit(float(a)))) for a in (0, 44, 91, 359, 225)] == ["right", "up-right", "up", "right", "down-left"]
    assert column(spark, scalars.first_reason((F.lit(False), "a"), (F.lit(True), "b"), (F.lit(True), "c"))) == "b"


def test_rows_without_a_time_match_nothing(spark):
    left = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None)], "k string, id int, t double")
    right = spark.createDataFrame([("a", None, 7), ("a", 9.0, 8)], "k string, rt double, v int")
    found = {r["id"]: r["matches"] for r in temporal.asof_backward(left, right, ["k"], "t", "rt", 2).collect()}
    assert [m["v"] for m in found[1]] == [8] and found[2] is None
    early = temporal.asof_backward(left.where("id = 1").withColumn("t", F.lit(5.0)), right, ["k"], "t", "rt").first()
    assert early["matches"] is None
    near = {r["id"]: r["match"] for r in temporal.nearest_within(left, right, ["k"], "t", "rt", F.lit(100.0)).collect()}
    assert near[1]["v"] == 8 and near[2] is None


def test_weeks_of_rows_without_a_time_are_not_the_total(spark):
    rows = spark.createDataFrame([("2026-01-05 10:00:00", 1.0), ("2026-01-06 10:00:00", 3.0), (None, 5.0)], "t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    found = {(str(r["week"]), r["all_weeks"]): r["mean"] for r in metrics.weekly(rows, "t", F.avg("v").alias("mean")).collect()}
    assert found == {("2026-01-04", False): 2.0, ("None", False): 5.0, ("None", True): 3.0}


def test_percentages(spark):
    assert [column(spark, scalars.percent(F.lit(v))) for v in (0.12345, 1.0, 0.0)] == ["12.35%", "100.00%", "0.00%"]
    assert column(spark, scalars.percent(F.lit(None).cast("double"))) is None


def test_a_wrong_streak_is_a_mismatch(spark):
    actual = spark.createDataFrame([("v", 1, "a1", 10, "hit", 0.1, 1), ("v", 2, "a2", 20, "miss", 0.1, 0), ("v", 3, "a3", 30, "hit", 0.1, 2)], "video string, sequence int, attempt_id string, anchor_frame_number int, outcome string, delay double, streak int")
    limits = spark.createDataFrame([("hit", 5.0), ("miss", 5.0)], "outcome string, limit double")
    found = ledger.replay_mismatches(actual.select("video", "sequence", "outcome"), actual, limits).collect()
    assert [(r["check"], r["detail"]) for r in found] == [("streak", "a3 shows 2, not 1")]


def test_label_counts_and_times_that_may_not_be_stored(spark):
    rows = [("v", "hit", 1.0), ("v", "miss", 2.0), ("v", "hit", 3.0), ("v", "uncertain", float("inf")), ("w", "miss", float("nan")), ("w", "none", -1.0)]
    labels = spark.createDataFrame(rows, "video string, outcome string, time_seconds double")
    counts = {r["video"]: (r["hit"], r["miss"], r["uncertain"]) for r in evaluation.label_counts(labels, "video").collect()}
    assert counts == {"v": (2, 1, 1), "w": (0, 1, 0)}
    reasons = [r["problem"] for r in evaluation.label_problems(labels).collect()]
    assert reasons == [None, None, None, "time", "time", "outcome"]
