"""The log parser on a synthetic log shaped by its own patterns; the answers are worked out by hand.

No real logs are at hand, so nothing here is a golden of one.
"""

import json

import pytest

from rallyline.operators import rally
from rallyline.sources import logs

NAMES = ["ann", "bob"]


def snapshot(server, scores, state=True):
    text = json.dumps({"PlayerIds": ["11", "22"], "PlayerNames": NAMES, "CurrentServer": server, "RoundScores": scores}, separators=(",", ":"))
    return "Snapshot reads: " + text[:-1] + ("," if state else "}")


def contact(kind, pos=(0.1, 0.2, 0.3), rate=(360.0, -720.0, 1080.0)):
    return f"MyCollision: pos:({pos[0]},{pos[1]},{pos[2]}) vel:(1.0,2.0,2.0) rrate:({rate[0]},{rate[1]},{rate[2]}) pongGameCollisionType:{kind}\n"


THEIR_HIT = "Received ball hit from opponent: pos:(0.1,0.2,0.3) vel:(1.0,2.0,2.0) rrate:(1.0,2.0,3.0)\n"
MY_HIT_LINE = "postCollisionState: pos:(0.5,0.6,0.7) vel:(3.0,4.0,0.5) rRate:(360.0,0.5,-720.0)\n"
MARK = '"PongGameState":"PrePoint"'


def match_log(username, points):
    """One match of one round; each point is (lines, snapshot after it)."""
    text = f"Properly authenticated {username}\nSending MP match prefab activity\n" + json.dumps({"PlayerIds": ["11", "22"], "PlayerNames": NAMES}) + "\nstart " + MARK + "}\n"
    for lines, after in points:
        text += lines + after + MARK + "}\n"
    return text


LEGAL_SERVE = contact("TossA") + contact("HitA") + MY_HIT_LINE + contact("TableA") + contact("TableB")
FAULT = contact("TossA") + contact("HitA") + MY_HIT_LINE + contact("Net")
RECEIVED = THEIR_HIT + THEIR_HIT + contact("TableB") + contact("TableA") + contact("HitA") + MY_HIT_LINE


@pytest.fixture(scope="module")
def parsed(spark):
    points = [
        (LEGAL_SERVE, snapshot(11, [[1, 0]])),
        (FAULT, snapshot(22, [[1, 1]])),
        ("nothing happens\n", snapshot(22, [[1, 1]])),
        (RECEIVED, snapshot(22, [[1, 2]])),
    ]
    raw = spark.createDataFrame([("ALL-7.3.2026.12.5.9.AM.log", match_log("ann", points))], "file_name string, content string")
    return logs.parse(raw)


def test_session_name_and_midnight(parsed):
    row = parsed.sessions.first()
    assert row["username"] == "ann"
    assert str(row["session_ts"]) == "2026-07-03 00:05:09"


def test_match(parsed):
    assert [(r["opponent"], r["is_first"]) for r in parsed.matches.collect()] == [("bob", True)]


def test_points_without_contacts_are_dropped_before_scores_move(parsed):
    points = parsed.points.orderBy("point_no").collect()
    assert [(p["is_server"], p["did_i_win"], p["is_fault"]) for p in points] == [(True, True, False), (True, False, True), (False, False, False)]


def test_contacts_begin_at_the_serve(parsed):
    received = parsed.contacts.where("point_no = 3").orderBy("coll_no").collect()
    assert [c["kind"] for c in received] == ["TheirHit", "TheirTable", "MyTable", "MyHit"]
    assert [c["is_serve"] for c in received] == [False, False, False, False]  # the first hit was cut off


def test_unforced_error_is_the_last_hit_after_the_last_table(parsed):
    flags = {(c["point_no"], c["coll_no"]): c["unforced_error"] for c in parsed.contacts.collect()}
    assert flags[3, 3] and flags[1, 1] and not any(v for (p, _), v in flags.items() if p == 0)


def test_hits_join_in_order(parsed):
    mine = [c["hit"] for c in parsed.contacts.where("kind = 'MyHit'").collect()]
    assert all(h["vx"] == 3.0 and h["rz"] == -2.0 and h["posz"] == 0.7 for h in mine) and len(mine) == 3


def test_vectors(parsed):
    c = parsed.contacts.where("point_no = 0 and coll_no = 0").first()
    assert (c["vx"], c["rx"], c["ry"], c["rz"], c["posx"]) == (1.0, 1.0, -2.0, 3.0, 0.1)


def test_second_player_is_mirrored(spark):
    raw = spark.createDataFrame([("ALL-7.3.2026.1.5.9.PM.log", match_log("bob", [(contact("HitB"), snapshot(22, [[0, 1]])), (contact("TossB") + contact("HitB"), snapshot(22, [[0, 2]]))]))], "file_name string, content string")
    parsed = logs.parse(raw)
    c = parsed.contacts.orderBy("coll_no").first()
    assert (c["kind"], c["vx"], c["rx"], c["posx"], c["posy"], c["posz"]) == ("MyToss", 1.0, -1.0, -0.1, 0.2, -0.3)
    assert parsed.matches.first()["opponent"] == "ann"
    assert parsed.sessions.first()["session_ts"].hour == 13
    assert [p["did_i_win"] for p in parsed.points.collect()] == [False]  # 0:2 is not how a round opens


def test_rates(parsed):
    r = rally.rates(parsed.points).first()
    assert (r["service_fault"], r["win_on_serve"], r["serve_ace"], r["return_ace"]) == (0.5, 0.5, 0.5, 1.0)
    assert rally.consistency(parsed.contacts).first()["consistency"] == pytest.approx(1 - 2 / 3)


def test_my_hits_to_table_toggles(parsed):
    assert rally.my_hits_to_table(parsed.contacts).count() == 1
    assert rally.my_hits_to_table(parsed.contacts, serve=False).count() == 0
    assert rally.my_hits_to_table(parsed.contacts, rally=False).count() == 1
    assert rally.my_hits_to_table(parsed.contacts, forehand=False).count() == 0
    assert rally.their_hits_to_table(parsed.contacts).count() == 2


def test_matches_won_and_last_table(parsed):
    row = rally.matches_won(parsed.points, parsed.matches).first()
    assert (row["rounds_won"], row["won"]) == (0, False)
    assert [(r["point_no"], r["coll_no"]) for r in rally.last_own_table_hits(parsed.points, parsed.contacts).collect()] == [(3, 2)]


def test_weekly_rates_and_spin(parsed):
    weeks = {str(r["week"]): r["win_on_serve"] for r in rally.weekly_rates(parsed).collect()}
    assert weeks == {"2026-06-28": 0.5, "None": 0.5}
    r = rally.spin_means(parsed.contacts).first()
    assert r["topspin"] is None and r["backspin"] == 2.0 and r["speed"] == pytest.approx(25.25**0.5)


def test_opponent_filter(parsed):
    assert rally.of_opponent(parsed.points, parsed.matches, "bob").count() == 3
    assert rally.of_opponent(parsed.points, parsed.matches, "cat").count() == 0


def test_files_and_broken_content(spark, tmp_path):
    (tmp_path / "ALL-1.2.2026.3.4.5.AM.log").write_text("no games here")
    (tmp_path / "odd.log").write_text("Sending MP match prefab activity\nnot json\n" + MARK)
    parsed = logs.parse(logs.read_logs(spark, str(tmp_path)), "someone")
    assert {r["file_name"]: r["session_ts"] is None for r in parsed.sessions.collect()} == {"ALL-1.2.2026.3.4.5.AM.log": False, "odd.log": True}
    assert parsed.points.count() == 0 and parsed.sessions.first()["username"] == "someone"
