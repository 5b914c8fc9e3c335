"""Votes between concurrent readings of one photo, and the zone of a page that holds a position.

Readings are rows (photo, box, pass_idx, lat, lon, notes, ...) after the parse.
A vote is an ordered fold per (photo, box, axis): values within a tolerance of a
group's leading value join it, and the leading value moves as votes arrive. It
runs over one list a photo, many photos at a time (``vote_fold``), so a photo costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from trailmark import constants as C
from trailmark.functions.geo import haversine_m, in_region, js_round
from trailmark.operators import parse_columns as N, vote_fold


def _voting(readings: DataFrame) -> DataFrame:
    """``readings`` with what each votes with (``vote_fold.FIELDS``)."""
    tess = F.col("tess").cast("double") if "tess" in readings.columns else F.lit(None).cast("double")
    on = F.coalesce(F.col("ok") & in_region("lat", "lon"), F.lit(False))
    notes = F.size("notes")
    return readings.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double"), "idx": F.col("pass_idx").cast("int"), "on": on, "w": F.when(notes > 0, 0.6).otherwise(1.0), "n_notes": notes, "tess_": tess})


def _folded(readings: DataFrame, keys: tuple[str, ...], own: list[str]) -> DataFrame:
    rows = _voting(readings).select(*keys, *own, *[f for f in vote_fold.FIELDS if f not in own])
    parts = [f"{k} {vote_fold.GROUP}" for k in vote_fold.GROUPS]
    schema = StructType([readings.schema[k] for k in keys] + StructType.fromDDL(", ".join(["total bigint", *parts, "heard double"])).fields)
    if own:
        schema = schema.add("first", "string").add("ref", StructType([rows.schema[c] for c in own])).add("apart", "boolean")
    return vote_fold.by_photo(rows, keys, own or ["idx"], vote_fold.settled(keys, own), schema)


def axis_votes(readings: DataFrame, keys: tuple[str, ...] = ("photo",)) -> DataFrame:
    """lat_best, lat_second, lon_best, lon_second of each photo; ``total`` counts all readings."""
    return _folded(readings, keys, []).drop("heard")


def firm(best: Column, second: Column) -> Column:
    """Three readings agree, two more than on any other value."""
    return F.coalesce((best["n"] >= C.VOTE_NEED) & (second.isNull() | (second["n"] <= best["n"] - C.VOTE_MARGIN)), F.lit(False))


def with_firm(votes: DataFrame) -> DataFrame:
    both = firm(F.col("lat_best"), F.col("lat_second")) & firm(F.col("lon_best"), F.col("lon_second"))
    rival = F.coalesce(F.col("lat_second.n") >= F.col("lat_best.n"), F.lit(False)) | F.coalesce(F.col("lon_second.n") >= F.col("lon_best.n"), F.lit(False))
    return votes.withColumns({"sure": both, "rival": rival})


def read_loop(readings: DataFrame, limit: int = 11, keys: tuple[str, ...] = ("photo",)) -> DataFrame:
    """The readings that a reader would have made: up to the first whose votes are firm on both axes.

    A photo's sorted readings are voted on until both axes are firm. One exchange; a photo's readings are
    at most ``limit``.
    """
    rows = _voting(readings.where(F.col("pass_idx") < limit))
    order = ["pass_idx", *[c for c in readings.columns if c not in (*keys, "pass_idx")]]
    out = StructType([rows.schema[c] for c in readings.columns])
    return vote_fold.by_photo(rows, keys, order, vote_fold.kept, out)


def settle(readings: DataFrame, keys: tuple[str, ...] = ("photo",)) -> DataFrame:
    """The settled reading of each photo: position, sure, rival, agreement, notes and other readings.

    Where no single reading holds both winning values, the pair is written out and parsed again.

    readings: keys, pass_idx, txt, ok, lat, lon, fmt, notes, alts (array of lat, lon), tess.
    """
    out = with_firm(_folded(readings, keys, ["pass_idx", "txt", "ok", "lat", "lon", "fmt", "notes", "alts", "tess"]))
    out = out.withColumn("none", F.col("lat_best").isNull() | F.col("lon_best").isNull())
    out = out.withColumns({c: F.col(f"ref.{c}") for c in ("lat", "lon", "fmt")})
    ref_notes, ref_alts = F.coalesce("ref.notes", F.array().cast("array<string>")), F.col("ref.alts")
    kept = F.when(F.col("sure"), F.filter(ref_notes, lambda x: ~x.contains("symbol"))).otherwise(F.concat(ref_notes, F.when(F.col("apart"), F.array(F.lit("two_readings"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("agreement"))))
    pair = F.struct(F.coalesce("lat_second.v", "lat_best.v").alias("lat"), F.coalesce("lon_second.v", "lon_best.v").alias("lon"))
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    other = F.when((F.col("lat_second").isNotNull() | F.col("lon_second").isNotNull()) & (haversine_m(pair["lat"], pair["lon"], "lat", "lon") > 5), F.array(pair)).otherwise(none)
    alts = F.when(F.col("sure"), none).otherwise(F.slice(F.concat(other, F.coalesce(ref_alts, none)), 1, 3))
    tess = js_round(F.when(F.col("apart"), F.col("heard")).otherwise(F.col("ref.tess")))
    blank = lambda c: F.when(~F.col("none"), c)
    text = F.when(F.col("none"), F.col("first")).otherwise(F.col("ref.txt"))
    return out.select(
        *keys, text.alias("text"), "none", (F.col("sure") & ~F.col("none")).alias("sure"), (F.col("rival") & ~F.col("none")).alias("rival"), blank(F.col("lat")).alias("lat"), blank(F.col("lon")).alias("lon"), blank(F.col("fmt")).alias("fmt"),
        F.when(F.col("none"), F.array().cast("array<string>")).otherwise(kept).alias("notes"), F.when(F.col("none"), none).otherwise(alts).alias("alts"), blank(F.least("lat_best.n", "lon_best.n")).alias("agree"), "total", blank(tess).cast("int").alias("tess"),
    )


def two_step(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("photo",)) -> DataFrame:
    """Which of two readings is kept: the wider one only if sure, or if only it has a position."""
    a = first.select(*keys, F.struct(*first.columns).alias("r1"))
    b = second.select(*keys, F.struct(*second.columns).alias("r2"))
    out = a.join(b, list(keys), "left")
    wide = ~F.col("r1.sure") & F.col("r2").isNotNull() & (F.col("r2.sure") | (F.col("r1.none") & ~F.col("r2.none")))
    return out.select(F.when(wide, "wide").otherwise("found").alias("box"), F.when(wide, F.col("r2")).otherwise(F.col("r1")).alias("r")).select("box", "r.*")


COORDINATE = r"[0-9]|^(?i:[nsewo])$|[°'\"]"


def has_coordinate(text: Column) -> Column:
    return text.rlike(COORDINATE)


def word_weight(text: Column) -> Column:
    return F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"\s", "")))


def words_confidence(words: DataFrame, *keys: str) -> DataFrame:
    """Length-weighted mean confidence of the words that bear coordinates, rounded; null without any."""
    use = has_coordinate(F.coalesce("text", F.lit(""))) & F.col("confidence").isNotNull()
    w = word_weight(F.col("text"))
    return words.groupBy(*keys).agg(js_round(F.sum(F.when(use, F.col("confidence") * w)) / F.sum(F.when(use, w))).cast("long").alias("confidence"))


def bounding_boxes(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def line_windows(lines: DataFrame, most: int = 3) -> DataFrame:
    """Windows of one to ``most`` consecutive lines of a page: page, i, k, text."""
    rows = lines.where(F.length(F.trim("text")) > 0)
    order = Window.partitionBy("page").orderBy("y0", "x0", "line")
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("t", F.trim("text"))
    ahead = F.collect_list("t").over(order.rowsBetween(Window.currentRow, most - 1))
    rows = rows.withColumn("ts", ahead)
    return rows.select("page", "i", F.explode(F.sequence(F.lit(1), F.size("ts"))).alias("k"), "ts").select("page", "i", "k", F.array_join(F.slice("ts", 1, F.col("k")), "\n").alias("text"))


def best_zone(lines: DataFrame, most: int = 3) -> DataFrame:
    """The window of a page whose text reads best: page, i, k, text, p, score."""
    rows = N.parse_once(line_windows(lines, most)).where("p.ok")
    score = F.col("p.best.score") - 0.3 * (F.col("k") - 1) - 0.5 * F.size("p.best.notes")
    rows = rows.withColumn("score", score)
    best = F.max_by(F.struct("i", "k", "text", "p", "score"), F.struct("score", -F.col("i"), -F.col("k")))
    return rows.groupBy("page").agg(best.alias("b")).select("page", "b.*")


def best_view(zones: DataFrame) -> DataFrame:
    """Of a photo's views the first clean one, else the one that ranks highest (photo, view, ord, p)."""
    clean = (F.size("p.best.notes") == 0) & (F.size("p.alts") == 0) & in_region("p.best.lat", "p.best.lon")
    rank = F.col("p.best.score") - 0.5 * F.size("p.best.notes") - 0.5 * F.size("p.alts")
    rows = zones.withColumns({"clean": clean, "rank": rank})
    pick = F.max_by(F.struct(*rows.columns), F.struct("clean", F.when(F.col("clean"), 0.0).otherwise(F.col("rank")), -F.col("ord")))
    return rows.groupBy("photo").agg(pick.alias("b")).select("b.*")
