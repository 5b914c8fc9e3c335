"""Inputs derived from the star-schema tables by integer arithmetic, and the same as SQL.

The tables hold no coordinates, so positions are made from keys; the SQL forms
serve the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(c: str) -> Column:
    """A zone-free timestamp read as UTC, whatever the session's zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))"))


def _grid(key: str, factor: int, size: int, base: float) -> Column:
    return F.lit(base) + (F.col(key) * factor % size) / 1000.0


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, seq, t, lat, lon, z, label, name: one row an event, inside the Alps box."""
    e = read(spark, sf_dir, "events")
    known = F.when(F.col("event_id") % 13 != 0, (F.col("event_id") * 37 % 2500).cast("double"))
    return e.select(
        F.col("user_id").alias("track"), F.col("event_id").alias("seq"), instant("ts").alias("t"), _grid("event_id", 7919, 4000, 44.0).alias("lat"), _grid("event_id", 104729, 4000, 5.0).alias("lon"),
        known.alias("z"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("label"), F.concat(F.lit("track "), F.col("user_id").cast("string")).alias("name"),
    )


SIGHTINGS = """s AS (SELECT user_id AS track, event_id AS seq, ts AS t, epoch_us(ts) // 1000 AS ms, 44.0::DOUBLE + (event_id * 7919 % 4000) / 1000.0::DOUBLE AS lat,
  5.0::DOUBLE + (event_id * 104729 % 4000) / 1000.0::DOUBLE AS lon, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id * 37 % 2500 AS DOUBLE) END AS z, event_id, user_id, value,
  CASE WHEN event_id % 3 = 0 THEN event_type END AS label FROM events)"""


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon over the whole globe."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _grid("c_custkey", 7919, 160000, -80.0).alias("lat"), _grid("c_custkey", 104729, 360000, -180.0).alias("lon"))


WORLD = """w AS (SELECT c_custkey AS id, -80.0::DOUBLE + (c_custkey * 7919 % 160000) / 1000.0::DOUBLE AS lat, -180.0::DOUBLE + (c_custkey * 104729 % 360000) / 1000.0::DOUBLE AS lon FROM customer)"""

#: DuckDB macros do not fit one statement, so these are templates.
SQUARE = "(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
HAVERSINE = f"(2 * 6371008.8::DOUBLE * asin(CASE WHEN {SQUARE} > 1 THEN 1 ELSE sqrt({SQUARE}) END))"
BEARING = "fmod(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360.0::DOUBLE, 360.0::DOUBLE)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return HAVERSINE.format(a=a, b=b, c=c, d=d)


def bear(a: str, b: str, c: str, d: str) -> str:
    return BEARING.format(a=a, b=b, c=c, d=d)


LEGS = f"""{SIGHTINGS},
l AS (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon, lag(ms) OVER o AS pms, lag(z) OVER o AS pz, row_number() OVER o - 1 AS i FROM s WINDOW o AS (PARTITION BY track ORDER BY t, seq)),
g AS (SELECT *, {hav("plat", "plon", "lat", "lon")} AS d, {bear("plat", "plon", "lat", "lon")} AS b, ms - pms AS dt FROM l)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, shape, text and what it says: exp_lat, exp_lon, exp_fmt."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    e = e.select("id", (F.col("id") % 8).cast("int").alias("shape"), (F.lit(44) + F.col("id") % 4).alias("dlat"), (F.col("id") * 7919 % 60000).alias("mlat"), (F.lit(5) + F.col("id") % 3).alias("dlon"), (F.col("id") * 10473 % 60000).alias("mlon"))
    two = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    minutes = lambda m: F.concat(F.lpad(F.floor(F.col(m) / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col(m) % 1000).cast("string"), 3, "0"))
    dd = lambda d, m, mark: F.concat(F.col(d).cast("string"), F.lit(mark), F.lpad((F.col(m)).cast("string"), 5, "0"))
    sec = lambda m: F.concat(F.lpad(F.floor(F.col(m) / 1000).cast("string"), 2, "0"), F.lit("'"), F.lpad(F.floor(F.col(m) % 1000 * 6 / 100).cast("string"), 2, "0"), F.lit("."), (F.col(m) % 10).cast("string"), F.lit('"'))
    shapes = [
        F.concat(F.lit("N "), two("dlat", 2), F.lit("°"), minutes("mlat"), F.lit("' E "), two("dlon", 3), F.lit("°"), minutes("mlon"), F.lit("'")),
        F.concat(two("dlat", 2), F.lit("° "), minutes("mlat"), F.lit("' "), two("dlon", 3), F.lit("° "), minutes("mlon"), F.lit("'")),
        F.concat(F.lit("position "), dd("dlat", "mlat", ","), F.lit(" "), dd("dlon", "mlon", ",")),
        F.concat(F.lit("GPS: "), dd("dlat", "mlat", "."), F.lit(", "), dd("dlon", "mlon", ".")),
        F.concat(F.lit("https://www.google.com/maps/?q="), dd("dlat", "mlat", "."), F.lit(","), dd("dlon", "mlon", ".")),
        F.concat(two("dlat", 2), F.lit("°"), sec("mlat"), F.lit("N "), two("dlon", 3), F.lit("°"), sec("mlon"), F.lit("E")),
        F.concat(dd("dlon", "mlon", "."), F.lit(" "), dd("dlat", "mlat", ".")),
        F.concat(F.lit("N "), two("dlat", 2), minutes("mlat"), F.lit(" E "), two("dlon", 3), minutes("mlon")),
    ]
    text = F.when(F.col("shape") == 0, shapes[0])
    for i, s in enumerate(shapes[1:], 1):
        text = text.when(F.col("shape") == i, s)
    return e.select("id", "shape", text.alias("text"))


def _axis(d: str, m: str) -> str:
    return f"""CASE WHEN shape IN (0, 1, 7) THEN {d} + {m} / 60000.0::DOUBLE WHEN shape = 5 THEN {d} + ({m} // 1000) / 60.0::DOUBLE + (({m} % 1000 * 6 // 100) + ({m} % 10) / 10.0::DOUBLE) / 3600.0::DOUBLE ELSE {d} + {m} / 100000.0::DOUBLE END"""


TEXTS = f"""x AS (SELECT event_id AS id, CAST(event_id % 8 AS INTEGER) AS shape, 44 + event_id % 4 AS dlat, event_id * 7919 % 60000 AS mlat, 5 + event_id % 3 AS dlon, event_id * 10473 % 60000 AS mlon FROM events),
e AS (SELECT id, shape, {_axis("dlat", "mlat")} AS lat, {_axis("dlon", "mlon")} AS lon,
  CASE shape WHEN 0 THEN 'DMM' WHEN 1 THEN 'DMM' WHEN 5 THEN 'DMS' WHEN 7 THEN 'NMEA' ELSE 'DD' END AS fmt, CASE WHEN shape IN (6, 7) THEN 'check' ELSE 'ok' END AS conf FROM x)"""
