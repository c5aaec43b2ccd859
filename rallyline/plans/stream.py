"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyline.plans.registry import query
from rallyline.session import SETTINGS, shared_dir, ship_package, table
from rallyline.streaming import attempts

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame) -> DataFrame:
    """All that the stream's input holds now, run through it with state in the shared folder, and read back."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    spark.conf.set(PROVIDER, SETTINGS[PROVIDER])
    ship_package(spark)
    running = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


@query("q40_stream_ledger", """
    WITH keyed AS (SELECT *, CAST(ts AS DATE) AS day, event_type = 'purchase' AS final FROM events), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY CASE WHEN final THEN 0 ELSE 1 END,
            CASE WHEN final THEN ts END, CASE WHEN final THEN event_id END, ts DESC, event_id DESC) AS n FROM keyed
    )
    SELECT user_id, CAST(day AS VARCHAR) AS day, event_id, final FROM ranked WHERE n = 1""")
def q40_stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts by user and day through keyed stream state: a day's first purchase is final, else its last event stands."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern may be a file or a folder
    rows = events.select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "ts", "event_id", (F.col("event_type") == "purchase").alias("final"))
    published = drained(attempts.stream_upserts(rows, ["user_id", "day"], ["ts", "event_id"], "final"))
    return attempts.latest(published, ["user_id", "day"], ["ts", "event_id"], "final").select("user_id", "day", "event_id", "final")
