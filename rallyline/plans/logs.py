"""Queries of the log pipeline: game logs written from events, through the parser and the rally metrics.

A session is a user's day, an event a point in order of ts and event_id. Its type says how it goes: a purchase is a
legal serve and won, a view a serve into the net and lost, a signup a return that lands and wins, a click one that does
not, an error a point without contacts. The snapshot after it names the server of the next: the user if its event_id is
even. Its time is the user_id in seconds after one o'clock of that day, so late users play on the next day. The SQL's
session_id says AM at any hour; the file's name says PM at noon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyline.operators import metrics, rally
from rallyline.plans.registry import query
from rallyline.session import table
from rallyline.sources import logs

OWN_ID, OTHER_ID = 11, 22
_PLAY = {
    "purchase": ("My Toss", "My Hit", "hit", "My Table", "Their Table"),
    "view": ("My Toss", "My Hit", "hit", "Net"),
    "click": ("serve", "Their Table", "My Table", "My Hit", "hit"),
    "signup": ("serve", "Their Table", "My Table", "My Hit", "hit", "Their Table"),
}


def _line(what: str, first: Column) -> Column:
    """A log line of one thing that happens in a point."""
    value = F.format_string("%.2f", F.col("value"))
    if what == "hit":
        return F.concat(F.lit("postCollisionState: pos:(0.5,0.6,0.7) vel:("), value, F.lit(",4.0,0.5) rRate:(360.0,0.5,-720.0)\n"))
    place = F.concat(F.lit("pos:(0.1,0.2,0.3) vel:("), value, F.lit(",2.0,2.0) rrate:(360.0,-720.0,1080.0)"))
    if what == "serve":
        return F.concat(F.lit("Received ball hit from opponent: "), place, F.lit("\n"))
    whose, _, kind = what.rpartition(" ")
    side = F.when(first == F.lit(whose == "My"), "A").otherwise("B") if whose else F.lit("")
    return F.concat(F.lit("MyCollision: "), place, F.lit(f" pongGameCollisionType:{kind}"), side, F.lit("\n"))


def _in_order(first: Column, mine: Column, other: Column) -> Column:
    """A JSON list of two, the first player's before the other's."""
    return F.concat(F.lit("["), F.when(first, mine).otherwise(other), F.lit(","), F.when(first, other).otherwise(mine), F.lit("]"))


def written(events: DataFrame) -> DataFrame:
    """session_id, file_name, content: a log for each user and day of events."""
    session, first = ["user_id", F.to_date("ts").alias("day")], F.col("user_id") % 2 == 0
    so_far = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    won, played = F.col("event_type").isin("purchase", "signup"), F.col("event_type") != "error"
    mine, theirs = (F.count_if(played & x).over(so_far).cast("string") for x in (won, ~won))
    quoted = lambda name: F.concat(F.lit('"'), name, F.lit('"'))
    own, other = F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("o"), F.col("user_id") % 7)
    head = F.concat(F.lit('{"PlayerIds":'), _in_order(first, F.lit(f'"{OWN_ID}"'), F.lit(f'"{OTHER_ID}"')), F.lit(',"PlayerNames":'), _in_order(first, quoted(own), quoted(other)))
    server = F.when(F.col("event_id") % 2 == 0, OWN_ID).otherwise(OTHER_ID)
    snapshot = F.concat(F.lit("Snapshot reads: "), head, F.lit(',"CurrentServer":'), server, F.lit(',"RoundScores":['), _in_order(first, mine, theirs), F.lit("],"))
    play = F.lit("nothing happens\n")
    for kind, things in _PLAY.items():
        play = F.when(F.col("event_type") == kind, F.concat(*(_line(t, first) for t in things))).otherwise(play)
    points = events.select(*session, "ts", "event_id", first.alias("first"), own.alias("own"), head.alias("head"), F.concat(play, snapshot, F.lit(logs.POINT_MARK + "}\n")).alias("text"))
    whole = points.groupBy("user_id", "day", "own", "head").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "text"))), lambda p: p["text"]), "").alias("text"))
    hour = F.floor(F.col("user_id") / 3600) + 1
    clock = [F.month("day"), F.dayofmonth("day"), F.year("day"), hour, F.floor(F.col("user_id") / 60) % 60, F.col("user_id") % 60]
    name = lambda half: F.concat(F.lit("ALL-"), F.concat_ws(".", *(c.cast("string") for c in clock), half), F.lit(".log"))
    start = F.concat(F.lit("Properly authenticated "), F.col("own"), F.lit(f"\n{logs.GAME_MARK}\n"), F.col("head"), F.lit("}\nstart " + logs.POINT_MARK + "}\n"))
    return whole.select(name(F.lit("AM")).alias("session_id"), name(F.when(hour == 12, "PM").otherwise("AM")).alias("file_name"), F.concat(start, F.col("text")).alias("content"))


def parsed(spark: SparkSession, sf_dir: str) -> logs.Logs:
    return logs.parse(written(table(spark, sf_dir, "events")))


_NAME = """'ALL-' || month(day) || '.' || day(day) || '.' || year(day) || '.' || (user_id // 3600 + 1) || '.' || (user_id // 60 % 60) || '.' || (user_id % 60) || '.AM.log'"""
_POINTS = f"""
    WITH numbered AS (
        SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS place FROM events
    ), played AS (
        SELECT *, {_NAME} AS session_id, event_id % 2 = 0 AS server, event_type IN ('purchase', 'signup') AS did_i_win
        FROM numbered WHERE event_type <> 'error'
    ), points AS (
        SELECT *, coalesce(lag(server) OVER (PARTITION BY user_id, day ORDER BY place), server) AS is_server FROM played
    ), judged AS (
        SELECT *, CASE WHEN is_server THEN event_type <> 'purchase' ELSE event_type NOT IN ('click', 'signup') END AS is_fault FROM points
    )
"""
_KINDS = "(VALUES ('purchase', 'MyToss', 0), ('purchase', 'MyHit', 1), ('purchase', 'MyTable', 2), ('purchase', 'TheirTable', 3), ('view', 'MyToss', 0), ('view', 'MyHit', 1), ('view', 'Net', 2), ('click', 'TheirHit', 0), ('click', 'TheirTable', 1), ('click', 'MyTable', 2), ('click', 'MyHit', 3), ('signup', 'TheirHit', 0), ('signup', 'TheirTable', 1), ('signup', 'MyTable', 2), ('signup', 'MyHit', 3), ('signup', 'TheirTable', 4)) AS k(event_type, kind, coll_no)"


@query("q43_log_sessions", f"""
    WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
    SELECT {_NAME} AS session_id, 'u' || user_id AS username, 'o' || (user_id % 7) AS opponent, user_id % 2 = 0 AS is_first,
           strftime(CAST(day AS TIMESTAMP) + to_hours(user_id // 3600 + 1) + to_seconds(user_id % 3600), '%Y-%m-%d %H:%M:%S') AS started FROM days""")
def q43_log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(spark, sf_dir)
    started = F.date_format("session_ts", "yyyy-MM-dd HH:mm:ss").alias("started")
    return found.sessions.join(found.matches, "session_id").select("session_id", "username", "opponent", "is_first", started)


@query("q44_log_points", _POINTS + "SELECT session_id, CAST(place AS INTEGER) AS point_no, is_server, did_i_win, is_fault FROM judged")
def q44_log_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).points.select("session_id", F.col("point_no").cast("int").alias("point_no"), "is_server", "did_i_win", "is_fault")


@query("q45_log_contacts", _POINTS + f"""
    SELECT session_id, kind, count(*) AS n, round(sum(value), 4) AS vx,
           count(*) FILTER (WHERE kind = 'MyHit' AND event_type IN ('view', 'click')) AS errors,
           count(*) FILTER (WHERE coll_no = 0 AND kind = 'TheirHit' OR coll_no = 1 AND kind = 'MyHit') AS serves
    FROM judged JOIN {_KINDS} USING (event_type) GROUP BY session_id, kind""")
def q45_log_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts by session and kind, with their speed, unforced errors and serves."""
    counted = (F.count("*").alias("n"), F.round(F.sum("vx"), 4).alias("vx"), F.count_if("unforced_error").alias("errors"), F.count_if("is_serve").alias("serves"))
    return parsed(spark, sf_dir).contacts.groupBy("session_id", "kind").agg(*counted)


@query("q46_log_hits", _POINTS + """
    SELECT session_id, count(*) AS n, round(max(sqrt(value * value + 16.25)), 4) AS fastest, round(sum(value), 4) AS vx FROM judged GROUP BY session_id""")
def q46_log_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by session with the fastest, through the n-th hit of each own hit contact."""
    own = parsed(spark, sf_dir).contacts.where("kind = 'MyHit'").select("session_id", "hit.*")
    speed = metrics.magnitude(F.col("vx"), F.col("vy"), F.col("vz"))
    return own.groupBy("session_id").agg(F.count("vx").alias("n"), F.round(F.max(speed), 4).alias("fastest"), F.round(F.sum("vx"), 4).alias("vx"))


_RATES = """round(count(*) FILTER (WHERE is_server AND is_fault) / nullif(count(*) FILTER (WHERE is_server), 0), 6) AS service_fault,
           round(count(*) FILTER (WHERE is_server AND did_i_win) / nullif(count(*) FILTER (WHERE is_server), 0), 6) AS win_on_serve,
           round(count(*) FILTER (WHERE is_server AND NOT is_fault) / nullif(count(*) FILTER (WHERE is_server), 0), 6) AS serve_ace,
           round(count(*) FILTER (WHERE NOT is_server AND NOT is_fault AND event_type = 'click') / nullif(count(*) FILTER (WHERE NOT is_server), 0), 6) AS return_ace"""
_RATE_NAMES = ("service_fault", "win_on_serve", "serve_ace", "return_ace")


@query("q47_log_rates", _POINTS + f"SELECT 'o' || (user_id % 7) AS opponent, {_RATES} FROM judged GROUP BY 1")
def q47_log_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(spark, sf_dir)
    rates = rally.rates(found.points.join(found.matches, logs.GAME), "opponent")
    return rates.select("opponent", *(F.round(c, 6).alias(c) for c in _RATE_NAMES))


@query("q48_log_weeks", _POINTS + f"""
    SELECT CASE WHEN grouping(week) = 1 THEN 'All' ELSE CAST(week AS VARCHAR) END AS week, {_RATES}
    FROM (SELECT *, day - CAST(dayofweek(day) AS INTEGER) AS week FROM judged) GROUP BY ROLLUP (week)""")
def q48_log_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = rally.weekly_rates(parsed(spark, sf_dir))
    return weeks.select(F.when(F.col("all_weeks"), "All").otherwise(F.col("week").cast("string")).alias("week"), *(F.round(c, 6).alias(c) for c in _RATE_NAMES))


@query("q49_log_matches", _POINTS + """
    SELECT session_id, CAST(CASE WHEN count(*) FILTER (WHERE did_i_win) > count(*) FILTER (WHERE NOT did_i_win) THEN 1 ELSE 0 END AS BIGINT) AS rounds_won,
           false AS won FROM (SELECT session_id, did_i_win FROM judged UNION ALL
                              SELECT DISTINCT """ + _NAME + """, CAST(NULL AS BOOLEAN) FROM numbered) GROUP BY session_id""")
def q49_log_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(spark, sf_dir)
    return rally.matches_won(found.points, found.matches).select("session_id", "rounds_won", "won")


@query("q50_log_consistency", _POINTS + f"""
    SELECT 'o' || (user_id % 7) AS opponent, count(*) FILTER (WHERE kind = 'TheirTable' AND coll_no > 1) AS landed,
           count(*) FILTER (WHERE kind = 'MyTable') AS theirs,
           round(1 - count(*) FILTER (WHERE kind = 'MyHit' AND event_type IN ('view', 'click')) / count(*) FILTER (WHERE kind = 'MyHit'), 6) AS consistency
    FROM judged JOIN {_KINDS} USING (event_type) GROUP BY 1""")
def q50_log_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By opponent: own hits that land, theirs, and the share of own hits that are no unforced error."""
    found = parsed(spark, sf_dir)
    contacts = found.contacts.join(found.matches.select(*logs.GAME, "opponent"), logs.GAME)
    landed = rally.my_hits_to_table(contacts).groupBy("opponent").agg(F.count("*").alias("landed"))
    theirs = rally.their_hits_to_table(contacts).groupBy("opponent").agg(F.count("*").alias("theirs"))
    share = rally.consistency(contacts, "opponent").select("opponent", F.round("consistency", 6).alias("consistency"))
    return share.join(landed, "opponent").join(theirs, "opponent")
