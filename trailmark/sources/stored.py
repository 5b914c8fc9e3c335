"""What devices and services leave behind: answers, histories, names, and streams of positions and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.functions.geo import valid_position

POSITION = "device long, seq long, t timestamp, lat double, lon double, accuracy double, age_ms long"
HEADING = "device long, seq long, t timestamp, heading double, pitch double, stop boolean"
ANSWER = "key string, status int, body string"
MOST_AGE_MS = 5000


def answers(rows: DataFrame, schema: str) -> DataFrame:
    """key, value, failed of service answers: JSON bodies of status 2xx; others, and bodies that are no JSON, failed."""
    good = F.col("status").between(200, 299)
    value = F.when(good, F.from_json("body", schema))
    broken = F.when(good, F.try_parse_json("body")).isNull()
    return rows.select("key", F.when(~broken, value).alias("value"), broken.alias("failed"))


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``answers`` of a folder of JSON lines (key, status, body)."""
    return answers(spark.read.schema(ANSWER).json(path), schema)


def stored_history(rows: DataFrame) -> DataFrame:
    """The kept entries of a stored history (owner, k, src, t, seq): those with a position text and a source text, which may be empty."""
    from trailmark.operators.track import history

    return history(rows.where(F.col("k").isNotNull() & F.col("src").isNotNull()))


def track_names(rows: DataFrame) -> DataFrame:
    """track, name: the last name that was given, blanks trimmed; none where it is empty."""
    last = rows.groupBy("track").agg(F.max_by(F.trim("name"), F.struct("t", "seq")).alias("name"))
    return last.select("track", F.nullif("name", F.lit("")).alias("name"))


def fresh(age_ms: Column) -> Column:
    return F.coalesce(age_ms, F.lit(0)) <= MOST_AGE_MS


def position_stream(spark: SparkSession, path: str) -> DataFrame:
    """Positions of devices as they arrive in a folder of JSON lines; old fixes and invalid ones are left out."""
    rows = spark.readStream.schema(POSITION).json(path)
    return rows.where(fresh(F.col("age_ms")) & valid_position("lat", "lon"))


def heading_stream(spark: SparkSession, path: str) -> DataFrame:
    """Headings and pitches of devices as they arrive in a folder of JSON lines."""
    return spark.readStream.schema(HEADING).json(path).where("stop or heading is not null")


def keep_late_points(stream: DataFrame, path: str, checkpoint: str):
    """A query that adds positions of devices to a stored track a device, late ones too (``runs.load_points`` orders them)."""
    from trailmark.sources.runs import keep_points, track_table

    points = stream.select(F.col("device").alias("track"), "seq", "t", "lat", "lon", F.lit(None).cast("string").alias("label"))
    return keep_points(points, track_table(stream.sparkSession, path), checkpoint)
