"""Game logs: raw text to sessions, matches, points, contacts and hits, all by Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyline.functions import scalars

#: Marks and formats of the log.
GAME_MARK = "Sending MP match prefab activity"
POINT_MARK = r'"PongGameState":"PrePoint"'
FIRST_ROUND_END = r'"RoundScores":\[\[\d+,\d+\],\[0,0\]\]'
SECOND_ROUND_END = r'"RoundScores":\[\[\d+,\d+\],\[\d+,\d+\],\[0,0\]\]'
CONTACT_MARKS = "(?:MyCollision:)|(?:Received ball hit from opponent:)"
OTHER_CONTACT = "YourCollision:"
NUMBER = r"(-?\d+(?:.\d+(?:E-\d+)?)?)"
VECTOR = rf"\({NUMBER},{NUMBER},{NUMBER}\)"
HIT_LINE = r"(postCollisionState:.*vel:\(-?\d+.\d+,-?\d+.\d+,-?\d+.\d+\).*rRate:\(-?\d+.\d+,-?\d+.\d+,-?\d+.\d+\))"
SNAPSHOT = "PlayerIds array<string>, PlayerNames array<string>, CurrentServer string, RoundScores array<array<int>>"
GAME, ROUND, POINT = ["session_id", "match_no"], ["session_id", "match_no", "round_no"], ["session_id", "match_no", "round_no", "point_no"]
HITS = ("MyHit", "TheirHit")


@dataclass(frozen=True)
class Logs:
    """The normalised tables; children refer to parents by key columns."""

    sessions: DataFrame
    matches: DataFrame
    points: DataFrame
    contacts: DataFrame
    hits: DataFrame


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content of every file under path, a file a row."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column, pattern: str, group: int) -> Column:
    """A matched number up to where it stops being one."""
    return F.regexp_extract(F.regexp_extract(text, pattern, group), r"^-?\d+(?:\.\d+(?:E-\d+)?)?", 0).try_cast("double")


def _flip(value: Column, first: str = "is_first") -> Column:
    return F.when(F.col(first), value).otherwise(-value)


def parse(raw: DataFrame, fallback_user: str | None = None) -> Logs:
    """All tables of raw(file_name, content), and session_id where that is not the file's name. A file without games
    gives a session only; broken parts give no rows. fallback_user is the user of logs that name none.
    """
    named = raw.select(
        F.col("session_id" if "session_id" in raw.columns else "file_name").alias("session_id"), "file_name", "content",
        F.coalesce(_found("content", r"Properly authenticated (\w+)"), F.lit(fallback_user).cast("string")).alias("username"),
        scalars.session_time(F.col("file_name")).alias("session_ts"), scalars.session_day(F.col("file_name")).alias("session_day"),
    )
    sessions = named.drop("content")
    games = named.select("session_id", "username", F.posexplode(scalars.pieces_after(F.col("content"), GAME_MARK)).alias("match_no", "game"))
    head = F.from_json(_found("game", r'(?m)^(\{"PlayerIds":.*)$'), "PlayerNames array<string>")["PlayerNames"]
    games = games.withColumn("names", head).withColumn("is_first", F.coalesce(F.col("names")[0] == F.col("username"), F.lit(False)))
    opponent = F.when(F.col("is_first"), F.col("names")[1]).otherwise(F.col("names")[0])
    games = games.where("names is not null").withColumn("opponent", opponent)
    first = scalars.first_pieces(F.col("game"), FIRST_ROUND_END, 2)
    later = F.when((F.size(first) > 1) & (F.length(first[1]) > 0), scalars.first_pieces(first[1], SECOND_ROUND_END, 2)).otherwise(F.array().cast("array<string>"))
    rounds = games.select(*GAME, "username", "is_first", F.posexplode(F.concat(F.array(first[0]), later)).alias("round_no", "round"))
    points = rounds.select(*ROUND, "username", "is_first", F.posexplode(_after(F.split("round", POINT_MARK))).alias("point_no", "point"))
    contacts = _contacts(points.select(*POINT, "is_first", "point"))
    hits = _hits(points.select(*POINT, "is_first", "point"))
    return Logs(sessions, games.select(*GAME, "opponent", "is_first"), _scored(points, contacts), _joined_hits(contacts, hits), hits)


def _after(parts: Column) -> Column:
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def _contacts(points: DataFrame) -> DataFrame:
    chunks = points.select(*POINT, "is_first", F.posexplode(_after(F.split("point", CONTACT_MARKS))).alias("chunk_no", "chunk"))
    text = F.substring_index("chunk", OTHER_CONTACT, 1)
    for short, long in (("pos:", "position:"), ("vel:", "velocity:"), ("rrate:", "rotationRate:")):
        text = scalars.first_replaced(text, short, long)
    chunks = chunks.withColumn("chunk", text)
    part = lambda name, i: _number("chunk", rf"{name}:{VECTOR}", i)
    typed = F.regexp_extract("chunk", "pongGameCollisionType:(.*)", 1)
    bare, side = F.expr("left(__type, length(__type) - 1)"), F.expr("right(__type, 1)")
    mine = (side == "A") == F.col("is_first")
    kind = F.when(~F.contains("chunk", F.lit("pongGameCollisionType:")), "TheirHit").when(side.isin("A", "B"), F.concat(F.when(mine, "My").otherwise("Their"), bare)).otherwise(F.col("__type"))
    measured = chunks.withColumn("__type", typed).select(
        *POINT, "chunk_no", kind.alias("kind"),
        *(F.coalesce(part("velocity", i), F.lit(0.0)).alias(c) for i, c in enumerate(("vx", "vy", "vz"), 1)),
        *((_flip(part("rotationRate", i)) / 360.0).alias(c) for i, c in enumerate(("rx", "ry", "rz"), 1)),
        F.coalesce(_flip(part("position", 1)), F.lit(0.0)).alias("posx"), F.coalesce(part("position", 2), F.lit(0.0)).alias("posy"),
        F.coalesce(_flip(part("position", 3)), F.lit(0.0)).alias("posz"),
    )
    return _cleaned(measured)


def _cleaned(contacts: DataFrame) -> DataFrame:
    """Roles in the point first, over all its contacts; then only those from the serve on, numbered anew."""
    order, whole = Window.partitionBy(*POINT).orderBy("chunk_no"), Window.partitionBy(*POINT)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_hit = F.col("kind").isin(*HITS)
    known = F.struct(F.col("rz"), F.col("chunk_no"), F.col("kind"))
    seen = contacts.withColumns({
        "is_serve": is_hit & (F.count_if(is_hit).over(before) == 0), "off_net": F.coalesce(F.lag("kind").over(order) == "Net", F.lit(False)),
        "__last": F.last(F.when(is_hit, known), ignorenulls=True).over(before), "__next": F.lead("kind").over(order),
    }).withColumn("__last_serve", F.last(F.when(is_hit, F.col("is_serve")), ignorenulls=True).over(before))
    starts = (F.col("kind") == "MyToss") | ((F.col("kind") == "TheirHit") & (F.coalesce("__next", F.lit("")) != "TheirHit"))
    from_serve = seen.withColumn("__from", F.min(F.when(starts, F.col("chunk_no"))).over(whole)).where(F.col("chunk_no") >= F.col("__from"))
    numbered = from_serve.withColumn("coll_no", (F.row_number().over(order) - 1).cast("int"))
    last_kind = F.last(F.when(is_hit, F.col("kind")), ignorenulls=True).over(before)
    landed = ((F.col("kind") == "MyTable") & (F.col("__own_last") == "TheirHit")) | ((F.col("kind") == "TheirTable") & (F.col("__own_last") == "MyHit"))
    ends = numbered.withColumn("__own_last", last_kind).withColumn("__hit_no", F.coalesce(F.max(F.when(is_hit, F.col("coll_no"))).over(whole), F.lit(0)))
    ends = ends.withColumn("__table_no", F.coalesce(F.max(F.when(landed, F.col("coll_no"))).over(whole), F.lit(0)))
    error = (F.col("coll_no") == F.col("__hit_no")) & (F.col("__hit_no") > F.col("__table_no"))
    return ends.withColumns({"unforced_error": error, "previous": F.lag("kind").over(order), "last_hit_rz": F.col("__last.rz"), "last_hit_is_serve": F.col("__last_serve"), "has_last_hit": F.col("__last").isNotNull()}).drop("chunk_no", "__last", "__last_serve", "__next", "__from", "__own_last", "__hit_no", "__table_no")


def _hits(points: DataFrame) -> DataFrame:
    lines = points.select(*POINT, "is_first", F.posexplode(F.regexp_extract_all("point", F.lit(HIT_LINE), F.lit(1))).alias("hit_no", "line"))
    part = lambda name, i: _number("line", rf"{name}:{VECTOR}", i)
    return lines.select(
        *POINT, "hit_no", *(part("vel", i).alias(c) for i, c in enumerate(("vx", "vy", "vz"), 1)),
        *((_flip(part("rRate", i)) / 360.0).alias(c) for i, c in enumerate(("rx", "ry", "rz"), 1)), *(part("pos", i).alias(c) for i, c in enumerate(("posx", "posy", "posz"), 1)),
    )


def _joined_hits(contacts: DataFrame, hits: DataFrame) -> DataFrame:
    """contacts with the struct hit: the n-th hit of a point belongs to its n-th own hit contact."""
    own = F.when(F.col("kind") == "MyHit", F.count_if(F.col("kind") == "MyHit").over(Window.partitionBy(*POINT).orderBy("coll_no")) - 1)
    packed = hits.select(*POINT, F.col("hit_no").cast("long").alias("__hit_no"), F.struct("vx", "vy", "vz", "rx", "ry", "rz", "posx", "posy", "posz").alias("hit"))
    return contacts.withColumn("__hit_no", own).join(packed, [*POINT, "__hit_no"], "left").drop("__hit_no")


def _scored(points: DataFrame, contacts: DataFrame) -> DataFrame:
    """Points with contacts and a snapshot: who served and who won, from this snapshot and the last such point's."""
    line = _found("point", r'(Snapshot reads:? \{"PlayerIds".*)')
    whole = F.when(F.contains(line, F.lit("PongGameState")), line).otherwise(F.concat(line, F.lit('"PongGameState":"PrePoint"}')))
    snapshot = F.from_json(F.concat(F.lit("{"), F.split(whole, r"\{")[1]), SNAPSHOT)
    kinds = contacts.groupBy(*POINT).agg(F.transform(F.sort_array(F.collect_list(F.struct("coll_no", "kind"))), lambda c: c["kind"]).alias("kinds"))
    known = points.withColumn("s", snapshot).where("s is not null").drop("point").join(kinds, POINT)
    me = F.when(F.col("s.PlayerNames")[0] == F.col("username"), F.col("s.PlayerIds")[0]).otherwise(F.col("s.PlayerIds")[1]).try_cast("long")
    order = Window.partitionBy(*ROUND).orderBy("point_no")
    before_server = F.nullif(F.lag(F.col("s.CurrentServer").try_cast("long")).over(order), F.lit(0))
    server = F.coalesce("__before_server", F.col("s.CurrentServer").try_cast("long"))
    known = known.withColumn("__before_server", before_server).withColumn("__before", F.lag("s.RoundScores").over(order))
    rated = known.withColumn("is_server", F.coalesce(server == me, F.lit(False))).withColumn("did_i_win", scalars.point_won(F.col("s.RoundScores"), F.col("__before"), F.col("is_first")))
    return rated.withColumn("is_fault", scalars.service_fault(F.col("kinds"), F.col("is_server"))).select(*POINT, "is_server", "did_i_win", "is_fault", "kinds")
