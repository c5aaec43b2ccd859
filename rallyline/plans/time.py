"""Queries of joins by nearness in time, upserts, slots and cadence, over events, orders and line items.

An attempt is a purchase, telemetry a view, evidence a click; times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyline.operators import cadence, ledger, temporal
from rallyline.plans.registry import query
from rallyline.session import table

HOUR = 3_600_000_000
USER = ["user_id"]


def micros(time: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {time})")


def of_type(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    """user_id, <name>_id, <name>_t, <name>_value of one event type."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select("user_id", F.col("event_id").alias(f"{name}_id"), micros("ts").alias(f"{name}_t"), F.col("value").alias(f"{name}_value"))


_SIDES = """
    WITH a AS (SELECT user_id, event_id AS attempt_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'purchase'),
         r AS (SELECT user_id, event_id AS reading_id, epoch_us(ts) AS rt, value FROM events WHERE event_type = 'view')
"""


@query("q13_asof_backward", _SIDES + "SELECT a.user_id, attempt_id, reading_id FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t >= r.rt")
def q13_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = temporal.asof_backward(of_type(spark, sf_dir, "purchase", "attempt"), of_type(spark, sf_dir, "view", "reading"), USER, "attempt_t", "reading_t")
    return met.select("user_id", "attempt_id", F.try_element_at("matches", F.lit(1))["reading_id"].alias("reading_id"))


@query("q14_asof_two", _SIDES + """
    SELECT user_id, attempt_id, reading_id, CAST(place AS BIGINT) AS place FROM (
        SELECT a.user_id, attempt_id, reading_id, row_number() OVER (PARTITION BY attempt_id ORDER BY rt DESC) AS place
        FROM a JOIN r ON a.user_id = r.user_id AND rt <= t
    ) WHERE place <= 2""")
def q14_asof_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = temporal.asof_backward(of_type(spark, sf_dir, "purchase", "attempt"), of_type(spark, sf_dir, "view", "reading"), USER, "attempt_t", "reading_t", k=2)
    placed = met.select("user_id", "attempt_id", F.posexplode("matches").alias("at", "m"))
    return placed.select("user_id", "attempt_id", F.col("m.reading_id").alias("reading_id"), (F.col("at") + 1).cast("long").alias("place"))


_NEAREST = """
    SELECT user_id, attempt_id, reading_id FROM (
        SELECT a.user_id, attempt_id, reading_id, row_number() OVER (PARTITION BY attempt_id ORDER BY abs(rt - t), rt) AS n
        FROM a JOIN r ON a.user_id = r.user_id AND abs(rt - t) <= {reach}
    ) WHERE n = 1"""


@query("q15_nearest_within", _SIDES + _NEAREST.format(reach=6 * HOUR))
def q15_nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = temporal.nearest_within(of_type(spark, sf_dir, "purchase", "attempt"), of_type(spark, sf_dir, "view", "reading"), USER, "attempt_t", "reading_t", F.lit(6 * HOUR))
    return met.where("match is not null").select("user_id", "attempt_id", F.col("match.reading_id").alias("reading_id"))


@query("q16_conditional_asof", _SIDES + f"""
    , near AS ({_NEAREST.format(reach=9 * HOUR)}), back AS (
        SELECT a.user_id, attempt_id, reading_id FROM a ASOF JOIN r ON a.user_id = r.user_id AND a.t >= r.rt
    )
    SELECT a.user_id, a.attempt_id, CASE WHEN a.value >= 40 THEN back.reading_id ELSE near.reading_id END AS reading_id
    FROM a LEFT JOIN near USING (attempt_id) LEFT JOIN back USING (attempt_id)""")
def q16_conditional_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts whose ball crossed the net (a value of 40 or more) take the last reading before, others the nearest."""
    attempts, readings = of_type(spark, sf_dir, "purchase", "attempt"), of_type(spark, sf_dir, "view", "reading")
    crossed = F.col("attempt_value") >= 40
    back = temporal.asof_backward(attempts.where(crossed), readings, USER, "attempt_t", "reading_t")
    near = temporal.nearest_within(attempts.where(~crossed), readings, USER, "attempt_t", "reading_t", F.lit(9 * HOUR))
    sides = (back.withColumn("match", F.try_element_at("matches", F.lit(1))), near)
    one, two = (s.select("user_id", "attempt_id", F.col("match.reading_id").alias("reading_id")) for s in sides)
    return one.unionByName(two)


@query("q17_interval_join", _SIDES + f"""
    SELECT a.user_id, attempt_id, count(*) AS readings, round(avg(r.value), 6) AS mean_value
    FROM a JOIN r ON a.user_id = r.user_id AND rt BETWEEN t - {HOUR} AND t + {HOUR} GROUP BY ALL""")
def q17_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = temporal.interval_join(of_type(spark, sf_dir, "purchase", "attempt"), of_type(spark, sf_dir, "view", "reading"), USER, "attempt_t", "reading_t", HOUR)
    return met.groupBy("user_id", "attempt_id").agg(F.count("*").alias("readings"), F.round(F.avg("reading_value"), 6).alias("mean_value"))


@query("q18_reconnect", f"""
    WITH e AS (SELECT user_id, event_id AS end_id, epoch_us(ts) AS end_t, value AS end_x FROM events WHERE event_type = 'click'),
         s AS (SELECT user_id, event_id AS start_id, epoch_us(ts) AS start_t, value AS start_x FROM events WHERE event_type = 'view')
    SELECT user_id, start_id, end_id FROM (
        SELECT s.user_id, start_id, end_id, row_number() OVER (PARTITION BY start_id ORDER BY start_t - end_t, end_x - start_x, end_id) AS n
        FROM s JOIN e ON s.user_id = e.user_id
        WHERE start_t - end_t > 0 AND start_t - end_t <= {24 * HOUR} AND start_x - end_x BETWEEN -20 AND 320 AND abs(start_x - end_x) <= 1e-8 * (start_t - end_t)
    ) WHERE n = 1""")
def q18_reconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends, starts = of_type(spark, sf_dir, "click", "end"), of_type(spark, sf_dir, "view", "start")
    ends, starts = ends.withColumnRenamed("end_value", "end_x"), starts.withColumnRenamed("start_value", "start_x")
    return temporal.reconnect(ends, starts, USER, 24 * HOUR, (-20.0, 320.0), 1e-8).select("user_id", "start_id", "end_id")


@query("q19_semi_and_anti", """
    SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned
    FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)""")
def q19_semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    orders = temporal.without(table(spark, sf_dir, "orders"), errors, "o_custkey")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return orders.join(returned.withColumn("returned", F.lit(True)), "o_orderkey", "left").select("o_orderkey", F.coalesce("returned", F.lit(False)).alias("returned"))


@query("q20_upserts", """
    WITH keyed AS (SELECT *, CAST(ts AS DATE) AS day, event_type = 'purchase' AS final FROM events), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY CASE WHEN final THEN 0 ELSE 1 END,
            CASE WHEN final THEN ts END, CASE WHEN final THEN event_id END, ts DESC, event_id DESC) AS n FROM keyed
    )
    SELECT user_id, CAST(day AS VARCHAR) AS day, event_id, final FROM ranked WHERE n = 1""")
def q20_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per user and day: its first finalized event, or else its last pending one."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")).withColumn("final", F.col("event_type") == "purchase")
    merged = ledger.merge_upserts(rows, ["user_id", "day"], ["ts", "event_id"], F.col("final"))
    return merged.select("user_id", F.col("day").cast("string").alias("day"), "event_id", "final")


@query("q21_streak_by_arrival", """
    WITH rows AS (SELECT user_id, place AS arrival, ts, event_type <> 'error' AS hit FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS place FROM events)),
    marked AS (SELECT *, max(CASE WHEN NOT hit THEN ts END) OVER (PARTITION BY user_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS miss FROM rows)
    SELECT a.user_id, CAST(a.arrival AS BIGINT) AS arrival, count(*) FILTER (b.hit AND b.arrival <= a.arrival AND (a.miss IS NULL OR b.ts > a.miss)) AS streak
    FROM marked a LEFT JOIN rows b ON a.user_id = b.user_id GROUP BY ALL""")
def q21_streak_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks as attempts come in out of order: here by value."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).cast("long")
    rows = table(spark, sf_dir, "events").withColumn("arrival", order)
    return ledger.arrival_streak(rows, USER, "arrival", "ts", F.col("event_type") != "error")


@query("q22_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q22_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


LIMITS = {"1-URGENT": 300, "2-HIGH": 600, "3-MEDIUM": 900, "4-NOT SPECIFIED": 1200, "5-LOW": 1500}


@query("q23_late", f"""
    WITH limits(o_orderpriority, most) AS (VALUES {', '.join(str(x) for x in LIMITS.items())}),
         shipped AS (SELECT o_orderkey, o_orderpriority, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(max(l_shipdate) AS DATE)) AS BIGINT) AS delay
                     FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate)
    SELECT o_orderkey, o_orderpriority, delay FROM shipped JOIN limits USING (o_orderpriority) WHERE delay > most""")
def q23_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    delay = F.date_diff(F.col("shipped").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("delay")
    published = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderpriority", delay)
    limits = spark.createDataFrame(list(LIMITS.items()), "o_orderpriority string, most int")
    return ledger.late_publications(published, limits, "o_orderpriority", "delay", "most").drop("most")


@query("q24_daily_slots", """
    WITH counted AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), every AS (
        SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM counted GROUP BY user_id)
    SELECT user_id, CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM every LEFT JOIN counted USING (user_id, day)""")
def q24_daily_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.daily_slots(table(spark, sf_dir, "events"), USER, F.col("ts").cast("date")).withColumn("day", F.col("day").cast("string"))


_GRID = [4.0 + 0.1 * i for i in range(60)]


@query("q25_cadence", f"""
    WITH grid AS (SELECT unnest({_GRID}) AS period), hits AS (
        SELECT user_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) / 3600 AS t FROM events WHERE event_type = 'purchase'
    ), known AS (SELECT *, min(t) OVER u AS first, count(*) OVER u AS n FROM hits WINDOW u AS (PARTITION BY user_id)),
    met AS (
        SELECT user_id, period, n, round(abs((t - first + period / 2) - period * floor((t - first + period / 2) / period) - period / 2), 9) AS r FROM known CROSS JOIN grid WHERE n >= 3
    ), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY r) AS place FROM met) WHERE place <= greatest(3, round_even(n * 0.9, 0))),
    means AS (SELECT user_id, period, round(avg(r), 7) AS mean FROM kept GROUP BY ALL)
    SELECT user_id, round(arg_min(period, mean * 1e6 + period), 1) AS period FROM means GROUP BY user_id""")
def q25_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", (F.floor(micros("ts") / 1_000_000).cast("double") / 3600).alias("t"))
    return cadence.fit_period(hits, USER, "t", _GRID).withColumn("period", F.round("period", 1))


@query("q26_nearest_slot", f"""
    WITH h AS (SELECT user_id, event_id AS hit_id, epoch_us(ts) AS hit_t, value FROM events WHERE event_type = 'click'),
         s AS (SELECT user_id, event_id AS slot_id, epoch_us(ts) AS slot_t FROM events WHERE event_type = 'purchase'),
    nearest AS (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY abs(slot_t - hit_t), slot_t) AS n
                FROM (SELECT h.*, slot_id, slot_t FROM h JOIN s ON h.user_id = s.user_id AND abs(slot_t - hit_t) <= {12 * HOUR}))
    SELECT user_id, slot_id, hit_id FROM (
        SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY abs(slot_t - hit_t), value DESC, hit_t, hit_id) AS m FROM nearest WHERE n = 1) WHERE m = 1""")
def q26_nearest_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, slots = of_type(spark, sf_dir, "click", "hit"), of_type(spark, sf_dir, "purchase", "slot").drop("slot_value")
    met = temporal.nearest_slot(hits, slots, USER, "hit_t", "slot_t", F.lit(12 * HOUR), "hit_value", "hit_id")
    return met.select("user_id", F.col("match.slot_id").alias("slot_id"), "hit_id")


@query("q41_union_unless_same", """
    SELECT user_id, day, kind FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 'hit' AS kind FROM events WHERE event_type = 'purchase') UNION ALL
    SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR), 'extra' FROM events e WHERE event_type = 'click' AND NOT EXISTS (
        SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND f.user_id = e.user_id AND CAST(f.ts AS DATE) = CAST(e.ts AS DATE))""")
def q41_union_unless_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    sides = (rows.where(F.col("event_type") == t).select("user_id", "day", F.lit(k).alias("kind")) for t, k in (("purchase", "hit"), ("click", "extra")))
    return temporal.union_unless_same(*sides, "user_id", "day")


@query("q42_first_twenty", """
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) - 20 AS n_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def q42_first_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first 20 and how many more there are: the limit is the feature."""
    orders = table(spark, sf_dir, "orders")
    first = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")
    return first.crossJoin(F.broadcast(orders.agg((F.count("*") - 20).alias("n_more"))))  # one row
