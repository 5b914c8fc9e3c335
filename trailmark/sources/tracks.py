"""Track files and links in, and out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.operators import track as K


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (id, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("id"), F.col("value").alias("text"))


def fragment_text(hash_column: str = "hash"):
    """The text of a ``#lat,lon`` fragment; null for any other."""
    h = F.regexp_replace(F.coalesce(hash_column, F.lit("")), "^#", "")
    h = F.coalesce(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h)
    return F.when(h.rlike(r"^-?[0-9]+(\.[0-9]+)?,-?[0-9]+(\.[0-9]+)?$"), h)


def import_files(files: DataFrame) -> DataFrame:
    """Points of files that hold GPX or, on any line, a track link: id, name, seq, lat, lon, t, label."""
    xml = F.col("text").rlike(r"^\s*<")
    gpx = K.from_gpx(files.where(xml).select("id", F.col("text").alias("gpx")))
    links = files.where(~xml).select("id", F.regexp_extract("text", r"(?m)#?(s=[^\s#]+)", 1).alias("hash")).where("hash <> ''")
    return gpx.unionByName(K.decode_links(links))


def write_gpx(points: DataFrame, path: str, files: int = 64) -> None:
    """One row a document (track, gpx), dealt to ``files`` files by a hash of the track."""
    K.to_gpx(points).repartition(files, "track").write.mode("overwrite").parquet(path)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Points of the documents that ``write_gpx`` wrote: id (the track), name, seq, lat, lon, t, label."""
    return K.from_gpx(spark.read.parquet(path).withColumnRenamed("track", "id"))


def save_track(points: DataFrame, path: str) -> None:
    """Points in the order of their dates, as Parquet."""
    points.repartition("track").sortWithinPartitions("track", "t", "seq").write.mode("overwrite").parquet(path)


def load_track(spark: SparkSession, path: str) -> DataFrame:
    """Stored points; rows without a valid position or date are left out."""
    from trailmark.functions.geo import valid_position

    return spark.read.parquet(path).where(valid_position("lat", "lon") & F.col("t").isNotNull())
