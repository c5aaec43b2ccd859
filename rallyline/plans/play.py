"""Queries of streaks, rates, means and maps of play, over events, orders and line items.

An attempt is an event in order of ts and event_id of its user, a hit any that is not an error. A point is a line
item, a match an order, a session a customer; status O serves, return flag R is a fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyline.operators import ledger, metrics
from rallyline.plans.registry import query
from rallyline.session import table

USER, ORDER = ["user_id"], ["ts", "event_id"]


def _hit() -> Column:
    return F.col("event_type") != "error"


_STREAK_SQL = """
    WITH island AS (
        SELECT user_id, event_id, ts, event_type,
               sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
                   OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
        FROM events
    ), streaks AS (
        SELECT user_id, event_id, ts,
               CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)
                   OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak
        FROM island
    )
"""


@query("q01_streak", _STREAK_SQL + "SELECT user_id, event_id, streak FROM streaks")
def q01_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.hit_streak(table(spark, sf_dir, "events"), USER, ORDER, _hit()).select("user_id", "event_id", "streak")


@query("q02_best_streak", _STREAK_SQL + """
    SELECT user_id, event_id, max(streak) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best
    FROM streaks""")
def q02_best_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    streaks = ledger.hit_streak(table(spark, sf_dir, "events"), USER, ORDER, _hit())
    return ledger.running_best(streaks, USER, ORDER).select("user_id", "event_id", "best")


@query("q03_consistency", """
    SELECT user_id, round(1 - count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type IN ('click', 'error')), 0), 9) AS consistency
    FROM events GROUP BY user_id""")
def q03_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = metrics.consistency(F.col("event_type") == "error", F.col("event_type").isin("click", "error"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(rate, 9).alias("consistency"))


@query("q04_fault_percentage", """
    SELECT CAST(year(l_shipdate) AS BIGINT) AS ship_year,
           round(100.0 * count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') / nullif(count(*) FILTER (l_linestatus = 'O'), 0), 6) AS fault_percentage
    FROM lineitem GROUP BY 1""")
def q04_fault_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = metrics.percentage(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("ship_year")).agg(F.round(rate, 6).alias("fault_percentage"))


@query("q05_win_on_serve", """
    SELECT o_orderpriority, round(100.0 * count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) / nullif(count(*) FILTER (l_linestatus = 'O'), 0), 6) AS win_percentage
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def q05_win_on_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rate = metrics.percentage(F.col("l_quantity") > 25, F.col("l_linestatus") == "O")
    return points.groupBy("o_orderpriority").agg(F.round(rate, 6).alias("win_percentage"))


@query("q06_aces", """
    WITH points AS (
        SELECT l_orderkey, max(l_linestatus) AS status, count(*) FILTER (l_returnflag = 'R') AS faults,
               count(*) FILTER (l_tax > 0.04) AS own_table, count(*) FILTER (l_discount > 0.05) AS their_table
        FROM lineitem GROUP BY l_orderkey
    )
    SELECT o_orderpriority,
           round(100.0 * count(*) FILTER (status = 'O' AND faults = 0 AND own_table < 2) / nullif(count(*) FILTER (status = 'O'), 0), 6) AS serve_ace_percentage,
           round(100.0 * count(*) FILTER (status = 'F' AND faults = 0 AND their_table < 2) / nullif(count(*) FILTER (status = 'F'), 0), 6) AS return_ace_percentage
    FROM points JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def q06_aces(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linestatus").alias("status"), F.count_if(F.col("l_returnflag") == "R").alias("faults"),
        F.count_if(F.col("l_tax") > 0.04).alias("own_table"), F.count_if(F.col("l_discount") > 0.05).alias("their_table"),
    )
    serve = metrics.percentage((F.col("faults") == 0) & (F.col("own_table") < 2), F.col("status") == "O")
    back = metrics.percentage((F.col("faults") == 0) & (F.col("their_table") < 2), F.col("status") == "F")
    joined = points.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.round(serve, 6).alias("serve_ace_percentage"), F.round(back, 6).alias("return_ace_percentage"))


@query("q07_matches_won", """
    WITH rounds AS (
        SELECT l_orderkey, l_linenumber, count(*) FILTER (l_returnflag = 'N') > count(*) FILTER (l_returnflag <> 'N') AS won
        FROM lineitem GROUP BY ALL
    ), matches AS (
        SELECT l_orderkey, count(*) FILTER (won) > 1 AS won, count(*) FILTER (won) AS rounds_won FROM rounds GROUP BY ALL
    )
    SELECT o_custkey, CAST(count(*) FILTER (won) AS BIGINT) AS matches_won, CAST(sum(rounds_won) AS BIGINT) AS rounds_won
    FROM matches JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def q07_matches_won(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.col("l_returnflag") == "N"
    rounds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(metrics.won_more(F.count_if(mine), F.count_if(~mine)).alias("won"))
    matches = rounds.groupBy("l_orderkey").agg((F.count_if("won") > 1).alias("won"), F.count_if("won").alias("rounds_won"))
    sessions = matches.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey")
    return sessions.agg(F.count_if("won").alias("matches_won"), F.sum("rounds_won").alias("rounds_won"))


_WEEK = "CAST(date_trunc('day', ts) AS DATE) - CAST(dayofweek(ts) AS INTEGER)"


@query("q08_weekly_means", f"SELECT CAST({_WEEK} AS VARCHAR) AS week, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def q08_weekly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = metrics.week_start(F.col("ts")).cast("string").alias("week")
    return table(spark, sf_dir, "events").groupBy(week).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("q09_weekly_and_all", f"""
    WITH weeks AS (SELECT {_WEEK} AS week, value FROM events)
    SELECT coalesce(CAST(week AS VARCHAR), 'All') AS week, round(avg(value), 6) AS mean, count(*) AS n FROM weeks GROUP BY ROLLUP (week)""")
def q09_weekly_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = metrics.weekly(table(spark, sf_dir, "events"), "ts", F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return weeks.select(F.when(F.col("all_weeks"), "All").otherwise(F.col("week").cast("string")).alias("week"), "mean", "n")


@query("q10_heatmap", """
    WITH cells AS (
        SELECT CAST(trunc((l_discount * 16 - 0.8 + 0.8) * 250) AS INTEGER) AS px, 350 - CAST(trunc((l_quantity / 20 - 1.25) * 250) AS INTEGER) AS pz FROM lineitem
    ), counted AS (
        SELECT px - px % 5 AS gx, pz - pz % 5 AS gz, count(*) AS n FROM cells WHERE px BETWEEN 0 AND 399 AND pz BETWEEN 0 AND 699 GROUP BY ALL
    )
    SELECT gx, gz, n, max(n) OVER () AS most FROM counted""")
def q10_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.heatmap(table(spark, sf_dir, "lineitem"), F.col("l_discount") * 16 - 0.8, F.col("l_quantity") / 20 - 1.25)


_TOGGLES = ("forehand", "backhand", "net", "serve", "rally")


@query("q11_hits_to_table", """
    WITH played AS (
        SELECT *, lag(event_type) OVER w AS before_type,
               last_value(CASE WHEN event_type IN ('click', 'view') THEN value END IGNORE NULLS) OVER p AS hit_value,
               count(*) FILTER (event_type IN ('click', 'view')) OVER p AS hits
        FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
               p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), landed AS (
        SELECT user_id, hit_value >= 40 AS forehand, hit_value < 40 AS backhand, coalesce(before_type = 'error', false) AS net, hits = 1 AS serve
        FROM played WHERE event_type = 'purchase' AND coalesce(before_type, '') <> 'view' AND hits > 0
    )
    SELECT user_id, count(*) AS all_hits, count(*) FILTER (NOT forehand) AS forehand, count(*) FILTER (NOT backhand) AS backhand,
           count(*) FILTER (NOT net) AS net, count(*) FILTER (NOT serve) AS serve, count(*) FILTER (serve) AS rally
    FROM landed GROUP BY user_id""")
def q11_hits_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with the far table not right after the other side's hit; one count with each toggle switched off."""
    hit = F.col("event_type").isin("click", "view")
    played = metrics.last_earlier(table(spark, sf_dir, "events"), USER, ORDER, hit, F.struct("value"), "last_hit")
    before = Window.partitionBy(*USER).orderBy(*ORDER)
    played = played.withColumn("hits", F.count_if(hit).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    played = played.withColumn("before_type", F.lag("event_type").over(before))
    landed = played.where((F.col("event_type") == "purchase") & (F.coalesce("before_type", F.lit("")) != "view") & (F.col("hits") > 0))
    off = {
        "forehand": F.col("last_hit.value") >= 40, "backhand": F.col("last_hit.value") < 40,
        "net": F.coalesce(F.col("before_type") == "error", F.lit(False)), "serve": F.col("hits") == 1, "rally": F.col("hits") != 1,
    }
    return landed.groupBy("user_id").agg(F.count("*").alias("all_hits"), *(F.count_if(~off[t]).alias(t) for t in _TOGGLES))


@query("q12_truthy_means", """
    SELECT l_returnflag, round(avg(CASE WHEN l_discount <> 0 THEN l_discount END), 6) AS mean_discount, round(avg(CASE WHEN l_tax <> 0 THEN l_tax END), 6) AS mean_tax
    FROM lineitem GROUP BY 1""")
def q12_truthy_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = (F.round(metrics.truthy_mean(f"l_{c}"), 6).alias(f"mean_{c}") for c in ("discount", "tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*means)


@query("q35_trim_to_serve", """
    WITH marked AS (
        SELECT *, row_number() OVER w AS no, event_type = 'signup' OR (event_type = 'view' AND coalesce(lead(event_type) OVER w, '') <> 'view') AS starts
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    )
    SELECT user_id, event_id, event_type FROM (SELECT *, min(CASE WHEN starts THEN no END) OVER (PARTITION BY user_id) AS first FROM marked) WHERE no >= first""")
def q35_trim_to_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = F.coalesce(F.lead("event_type").over(Window.partitionBy(*USER).orderBy(*ORDER)), F.lit(""))
    starts = (F.col("event_type") == "signup") | ((F.col("event_type") == "view") & (ahead != "view"))
    return metrics.trimmed_to_first(table(spark, sf_dir, "events"), USER, ORDER, starts).select("user_id", "event_id", "event_type")


@query("q36_last_hit_and_errors", """
    WITH numbered AS (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS no FROM events
    ), seen AS (
        SELECT *, last_value(CASE WHEN event_type IN ('click', 'view') THEN event_id END IGNORE NULLS) OVER p AS last_hit,
               last_value(CASE WHEN event_type IN ('click', 'view') THEN event_type END IGNORE NULLS) OVER p AS last_kind
        FROM numbered WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), ends AS (
        SELECT *, coalesce(max(CASE WHEN event_type IN ('click', 'view') THEN no END) OVER u, 0) AS hit_no,
               coalesce(max(CASE WHEN (event_type = 'purchase' AND last_kind = 'click') OR (event_type = 'signup' AND last_kind = 'view') THEN no END) OVER u, 0) AS table_no
        FROM seen WINDOW u AS (PARTITION BY user_id)
    )
    SELECT user_id, event_id, last_hit, no = hit_no AND hit_no > table_no AS unforced_error FROM ends""")
def q36_last_hit_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier hit of each contact; the last hit of a point is an unforced error if no table contact by the
    other side's ball came after it. Both places default to 0 and are compared strictly."""
    hit = F.col("event_type").isin("click", "view")
    seen = metrics.last_earlier(table(spark, sf_dir, "events"), USER, ORDER, hit, F.struct("event_id", "event_type"), "last")
    seen = seen.withColumn("no", F.row_number().over(Window.partitionBy(*USER).orderBy(*ORDER)) - 1)
    whole, kind = Window.partitionBy(*USER), F.col("event_type")
    landed = ((kind == "purchase") & (F.col("last.event_type") == "click")) | ((kind == "signup") & (F.col("last.event_type") == "view"))
    ends = seen.withColumn("hit_no", F.coalesce(F.max(F.when(hit, F.col("no"))).over(whole), F.lit(0)))
    ends = ends.withColumn("table_no", F.coalesce(F.max(F.when(landed, F.col("no"))).over(whole), F.lit(0)))
    error = (F.col("no") == F.col("hit_no")) & (F.col("hit_no") > F.col("table_no"))
    return ends.select("user_id", "event_id", F.col("last.event_id").alias("last_hit"), error.alias("unforced_error"))


@query("q38_magnitude", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS magnitude FROM embeddings")
def q38_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(metrics.vector_magnitude("embedding"), 4).alias("magnitude"))
