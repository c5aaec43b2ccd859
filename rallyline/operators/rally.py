"""Metrics of parsed logs: points(is_server, did_i_win, is_fault, kinds) and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.operators import metrics
from rallyline.sources.logs import GAME, POINT, ROUND, Logs


def of_opponent(rows: DataFrame, matches: DataFrame, opponent: str | None) -> DataFrame:
    """rows of matches against one opponent, or all; filtered before anything below the match is read."""
    return rows if opponent is None else rows.join(matches.where(F.col("opponent") == opponent).select(*GAME), GAME, "left_semi")


def rates(points: DataFrame, *by: str) -> DataFrame:
    """by and the rates in [0, 1] of serving and returning points; null without such points."""

    def share(part: Column, whole: Column) -> Column:
        return F.try_divide(F.count_if(part & whole).cast("double"), F.count_if(whole))

    def contacts(kind: str) -> Column:
        return F.size(F.filter("kinds", lambda k: k == kind))

    serving, fault = F.col("is_server"), F.col("is_fault")
    return points.groupBy(*by).agg(
        share(fault, serving).alias("service_fault"), share(F.col("did_i_win"), serving).alias("win_on_serve"),
        share(~fault & (contacts("MyTable") < 2), serving).alias("serve_ace"), share(~fault & (contacts("TheirTable") < 2), ~serving).alias("return_ace"),
    )


def consistency(contacts: DataFrame, *by: str) -> DataFrame:
    own = F.col("kind") == "MyHit"
    return contacts.groupBy(*by).agg(metrics.consistency(F.col("unforced_error"), own).alias("consistency"))


def my_hits_to_table(contacts: DataFrame, forehand: bool = True, backhand: bool = True, net: bool = True, serve: bool = True, rally: bool = True) -> DataFrame:
    """Contacts with the far table not right after the opponent's hit; each toggle switched off leaves some out."""
    rz, served = F.col("last_hit_rz"), F.coalesce("last_hit_is_serve", F.lit(False))
    left_out = F.coalesce(F.col("previous") == "TheirHit", F.lit(False))
    for on, reason in ((forehand, F.coalesce(rz >= 0, F.lit(False))), (backhand, F.coalesce(rz < 0, F.lit(False))), (serve, served), (rally, ~served), (net, F.col("off_net"))):
        left_out = left_out if on else left_out | reason
    return contacts.where((F.col("kind") == "TheirTable") & ~left_out)


def their_hits_to_table(contacts: DataFrame) -> DataFrame:
    return contacts.where("kind = 'MyTable'")


def matches_won(points: DataFrame, matches: DataFrame) -> DataFrame:
    """session_id, match_no, rounds_won, won: a round goes to strictly more points, a match to more than one round."""
    rounds = points.groupBy(*ROUND).agg((F.count_if("did_i_win") > F.count_if(~F.col("did_i_win"))).alias("won"))
    counted = matches.select(*GAME).join(rounds, GAME, "left").groupBy(*GAME).agg(F.count_if(F.coalesce("won", F.lit(False))).alias("rounds_won"))
    return counted.withColumn("won", F.col("rounds_won") > 1)


def last_own_table_hits(points: DataFrame, contacts: DataFrame) -> DataFrame:
    """Of lost points that end on an own hit, the last own-table contact before it."""
    lost = contacts.join(points.where(~F.col("did_i_win")).select(*POINT), POINT, "left_semi")
    whole = Window.partitionBy(*POINT)
    marked = lost.withColumn("__last", F.max_by("kind", "coll_no").over(whole)).withColumn("__table", F.max(F.when(F.col("kind") == "MyTable", F.col("coll_no"))).over(whole))
    return marked.where((F.col("__last") == "MyHit") & (F.col("coll_no") == F.col("__table"))).drop("__last", "__table")


def spin_means(contacts: DataFrame, *by: str) -> DataFrame:
    """Means over truthy values of topspin, backspin, speed and revolutions of own hits."""
    own = contacts.where((F.col("kind") == "MyHit") & F.col("hit").isNotNull()).select("*", F.col("hit.rz").alias("__rz"))
    measured = own.withColumns({
        "topspin": metrics.spin("__rz", True), "backspin": metrics.spin("__rz", False),
        "speed": metrics.magnitude(*(F.col(f"hit.{c}") for c in ("vx", "vy", "vz"))), "revs": metrics.magnitude(*(F.col(f"hit.{c}") for c in ("rx", "ry", "rz"))),
    })
    return measured.groupBy(*by).agg(*(metrics.truthy_mean(c).alias(c) for c in ("topspin", "backspin", "speed", "revs")))


def weekly_rates(logs: Logs) -> DataFrame:
    """week and rates of each week and, where all_weeks, of all points together; sessions without a day have a null week.
    The week is that of the day in the session's name, also where its hours run into the next day."""
    dated = logs.points.join(logs.sessions.select("session_id", metrics.week_start(F.col("session_day")).alias("week")), "session_id")
    together = rates(dated).withColumns({"week": F.lit(None).cast("date"), "all_weeks": F.lit(True)})
    return rates(dated, "week").withColumn("all_weeks", F.lit(False)).unionByName(together)
