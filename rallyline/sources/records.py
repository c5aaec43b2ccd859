"""Records in and out: JSON lines, label files, calibrations, reports, and the published event log."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyline.functions import scalars
from rallyline.operators.evaluation import label_problems

READING = "struct<speed_mps: double, spin_revolutions_per_second: int, spin_direction: struct<x: double, y: double, angle_degrees: double, label: string>, video_time_seconds: double>"
BOUNCE_EVENTS = (
    "video_time_seconds double, video_timestamp string, hit_table boolean, is_in boolean, outcome string, posx double, posy double, posz double, "
    f"confidence double, frame_number int, attempt_frame_number int, return_crossed_net boolean, hit {READING}, machine {READING}"
)
UPSERTS = "type string, attempt_id string, sequence int, anchor_frame_number int, state string, outcome string, frame_number int"
LABELS = "version int, labels array<struct<time_seconds: double, outcome: string>>"
POINT = "array<double>"
CALIBRATION = (
    f"description string, image_size array<int>, table_surface_y double, control_points array<struct<name: string, image: {POINT}, log: {POINT}>>, "
    f"table_polygon array<{POINT}>, table_contact_polygon array<{POINT}>, occlusion_polygon array<{POINT}>, tracking_polygon array<{POINT}>, "
    f"launcher_region {POINT}, return_region {POINT}, net_line array<{POINT}>, net_proximity_fraction double, warmup_launcher_tracks int, detector_settings map<string, string>"
)
REQUIRED = ("image_size", "table_surface_y", "control_points", "table_polygon", "net_line")


def read_jsonl(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """Records of a JSON lines file; blank lines are skipped, and no path is an empty table."""
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).json(path)


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Records in a stream or table of text lines; lines that are no JSON object are dropped."""
    looks = F.trim(F.col(column)).rlike(r"^\{.*\}$")
    parsed = lines.where(looks).select(F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """video, label_no, time_seconds, outcome of label documents, one a file."""
    documents = spark.read.schema(LABELS).json(path, multiLine=True).withColumn("video", F.col("_metadata.file_name"))
    return documents.select("video", F.posexplode("labels").alias("label_no", "label")).select("video", "label_no", "label.*")


def stored_labels(labels: DataFrame) -> DataFrame:
    """labels as they are stored: by time, to three places; reading them fails if one is not valid."""
    checked = label_problems(labels)
    bad = F.raise_error(F.concat(F.lit("label is not valid: "), F.col("problem"))).cast("boolean")
    good = checked.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(bad)).drop("problem")
    return good.withColumn("time_seconds", F.round("time_seconds", 3)).orderBy("time_seconds", "label_no")


def write_jsonl(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; null fields are left out but for the position's, which are written as null."""
    kept = [c for c in ("posx", "posy", "posz") if c in records.columns]
    records.select(_json_line(records, kept).alias("value")).write.mode(mode).text(path)


def _json_line(records: DataFrame, shown: list[str]) -> Column:
    """A record as JSON: fields that are null are left out, unless they are among those always shown."""
    parts = [F.to_json(F.struct(c), {"ignoreNullFields": "false" if c in shown else "true"}) for c in records.columns]
    inner = [F.nullif(F.regexp_replace(p, r"^\{|\}$", ""), F.lit("")) for p in parts]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def write_json_document(rows: DataFrame, path: str) -> None:
    """A report of one row as one JSON document; the file's folder is path."""
    rows.limit(1).select(F.to_json(F.struct(*rows.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report_markdown(report: dict) -> str:
    """A scorecard as a Markdown table, one line a figure."""
    lines = [f"| {name.replace('_', ' ')} | {value:.4f} |" if isinstance(value, float) else f"| {name.replace('_', ' ')} | {value} |" for name, value in report.items()]
    return "\n".join(["| figure | value |", "|-|-|", *lines]) + "\n"


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibrations, one a file; reading fails if a required key is missing or there are not four control points."""
    rows = spark.read.schema(CALIBRATION).json(path, multiLine=True)
    whole = F.lit(True)
    for name in REQUIRED:
        whole = whole & F.col(name).isNotNull()
    bad = F.raise_error(F.lit("calibration lacks a required key or has not four control points")).cast("boolean")
    return rows.where(F.when(whole & (F.size("control_points") == 4), F.lit(True)).otherwise(bad))


def homography(calibration: dict) -> list[list[float]]:
    """The matrix that takes image points to (x, z) on the table, from four control points."""
    rows, target = [], []
    for point in calibration["control_points"]:
        (x, y), (u, v) = point["image"][:2], (point["log"][0], point["log"][-1])
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        target += [u, v]
    h = np.linalg.solve(np.array(rows, float), np.array(target, float))
    return np.append(h, 1.0).reshape(3, 3).tolist()


def published_after(events: DataFrame, session: str, token: str | None) -> DataFrame:
    """What a subscriber that resumes with a session:index token has not seen yet, in order."""
    seen = scalars.resume_index(F.lit(token), session)
    return events.where((F.col("session") == session) & (F.col("event_id") > seen)).orderBy("event_id")


def replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Recorded messages as a stream, so many files a batch, in the order in which the files were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def stored_streak(value: Column) -> Column:
    """A best streak read back from storage; anything but a whole number of 0 or more is 0."""
    number = value.try_cast("long")
    return F.when(number >= 0, number).otherwise(0)


def mismatch_line(kind: Column, expected: Column, actual: Column) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.format_string("%s: expected %s, got %s", shown(kind), shown(expected), shown(actual))


def save_labels(labels: DataFrame, path: str) -> None:
    """One label document under path, in time order. A recording's labels are few and written by one task."""
    body = stored_labels(labels).agg(F.sort_array(F.collect_list(F.struct("time_seconds", "label_no", "outcome"))).alias("l"))
    stripped = F.transform("l", lambda s: F.struct(s["time_seconds"].alias("time_seconds"), s["outcome"].alias("outcome")))
    body.select(F.to_json(F.struct(F.lit(1).alias("version"), stripped.alias("labels"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def as_dict(report: DataFrame) -> dict:
    """A one-row report as plain values."""
    return json.loads(report.select(F.to_json(F.struct(*report.columns))).first()[0])


def write_bounce_diagnostics(diagnostics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The confirmed bounces of diagnostics(draw_frame, kind, reason, points) as JSON lines; other kinds are left out."""
    confirmed = diagnostics.where("kind = 'confirmed_bounce'").select("draw_frame", "kind", "reason", "points")
    confirmed.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_review_manifest(reviews: DataFrame, scorecard: dict, categories: list[str], path: str) -> None:
    """One JSON document of a recording's reviews in order of their number, each with room for a category and notes,
    under the scorecard's figures. A recording's errors are few and written by one task."""
    listed = reviews.withColumn("category", F.lit(None).cast("string")).withColumn("review_notes", F.lit(""))
    body = listed.agg(F.sort_array(F.collect_list(F.struct("review_number", *(c for c in listed.columns if c != "review_number")))).alias("reviews"))
    head = [F.array(*map(F.lit, categories)).alias("categories"), F.struct(*(F.lit(v).alias(k) for k, v in scorecard.items())).alias("scorecard")]
    document = F.to_json(F.struct(*head, "reviews"), {"ignoreNullFields": "false"})
    body.select(document.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_calibration(calibrations: DataFrame, path: str) -> None:
    """Calibrations as JSON documents that read_calibration() takes, a row a document of one line; one that lacks a
    required key or has not four control points fails."""
    whole = F.size("control_points") == 4
    for name in REQUIRED:
        whole = whole & F.col(name).isNotNull()
    bad = F.raise_error(F.lit("calibration lacks a required key or has not four control points")).cast("string")
    calibrations.select(F.when(whole, F.to_json(F.struct(*calibrations.columns))).otherwise(bad).alias("value")).write.mode("overwrite").text(path)


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """A stream's records appended to path as JSON lines, each batch once however often it is tried: the sink keeps its
    own log of batches, and the checkpoint where the stream was. Returns the started query; a fresh checkpoint and path
    begin anew."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
