"""Radius joins, nearest places, lookups by rounded point, pins and views."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from trailmark import constants as C
from trailmark.functions import text as T
from trailmark.functions.geo import bearing_deg, haversine_m

METRES_A_DEGREE = math.pi * C.SPHERE_M / 180


def cells(lat: Column, lon: Column, radius: float) -> tuple[Column, Column]:
    """Row and column of a grid whose cells are at least ``radius`` wide everywhere.

    Rows have one height; a row's columns widen with its latitude, taken at the
    edge nearest the pole of the row and its neighbours.
    """
    height = radius / METRES_A_DEGREE
    row = F.floor(lat / height).cast("long")
    return row, F.floor((lon + 180.0) / column_width(row, radius)).cast("long")


def column_width(row: Column, radius: float) -> Column:
    height = radius / METRES_A_DEGREE
    edge = F.least(F.lit(89.9), (F.abs(row) + 2) * height)
    return height / F.cos(F.radians(edge))


def radius_join(points: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """All (point, place) pairs within ``radius`` metres, with their distance ``d``.

    points and places need lat and lon; columns of places get the prefix ``p_``.
    Places are put in every cell that a point within the radius may lie in (three
    rows, in each the columns its longitude reach covers, also across the date
    line), so the join is one equi-join on cells; the exact distance decides. Its
    sides are sorted and may be split: the size of a small file says nothing of its
    rows in all their cells, so neither side is collected for a broadcast.
    """
    right = places.select(*[F.col(c).alias(f"p_{c}") for c in places.columns])
    row = F.floor(F.col("p_lat") / (radius / METRES_A_DEGREE)).cast("long")
    edge = F.abs("p_lat") + radius / METRES_A_DEGREE
    reach = F.when(edge > 89.9, 180.0).otherwise(F.least(F.lit(180.0), radius / METRES_A_DEGREE / F.cos(F.radians(F.least(F.lit(89.9), edge))) * 1.001))  # all round the poles

    def columns(r: Column) -> Column:
        w = column_width(r, radius)
        spans = F.array(*[F.struct((F.col("p_lon") - reach + 180.0 + turn).alias("a"), (F.col("p_lon") + reach + 180.0 + turn).alias("z")) for turn in (-360.0, 0.0, 360.0)])
        inside = F.filter(spans, lambda s: (s["z"] >= 0) & (s["a"] <= 360.0))
        ids = F.flatten(F.transform(inside, lambda s: F.sequence(F.floor(F.greatest(F.lit(0.0), s["a"]) / w).cast("long"), F.floor(F.least(F.lit(360.0), s["z"]) / w).cast("long"))))
        return F.transform(F.array_distinct(ids), lambda c: F.struct(r.alias("r"), c.alias("c")))

    near = F.flatten(F.transform(F.array(*[row + i for i in (-1, 0, 1)]), columns))
    right = right.withColumn("cell", F.explode(near)).select(*right.columns, F.col("cell.r").alias("cell_r"), F.col("cell.c").alias("cell_c"))
    r, c = cells(F.col("lat"), F.col("lon"), radius)
    left = points.withColumns({"cell_r": r, "cell_c": c})
    out = left.join(right.hint("merge"), ["cell_r", "cell_c"]).withColumn("d", haversine_m("lat", "lon", "p_lat", "p_lon"))
    return out.where(F.col("d") <= radius).drop("cell_r", "cell_c")


# Kinds of places by tag value.
KINDS = {
    "peak": "sommet", "saddle": "col", "waterfall": "cascade", "spring": "source", "cave_entrance": "grotte", "glacier": "glacier", "water": "lac",
    "alpine_hut": "refuge", "wilderness_hut": "cabane", "hamlet": "hameau", "village": "village", "locality": "lieu-dit", "isolated_dwelling": "lieu-dit",
}
RUNNING = ["river", "canal", "stream", "ditch", "wastewater"]


def kind_of(tags: Column) -> Column:
    """What a tagged place is, or null: passes and waterfalls first, running water never."""
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    known = lambda k: F.try_element_at(names, tag(k))
    river = (tag("natural") == "water") & tag("water").isin(RUNNING)
    return (
        F.when(tag("mountain_pass") == "yes", "col").when(tag("waterway") == "waterfall", "cascade").when(F.coalesce(river, F.lit(False)), F.lit(None).cast("string"))
        .otherwise(F.coalesce(known("natural"), known("tourism"), known("place")))
    )


def nearest_places(points: DataFrame, places: DataFrame, k: int = 3, radius: float = C.PLACE_RADIUS_M) -> DataFrame:
    """The ``k`` nearest named places of each point: id, place, name, kind, d, b.

    points: id, lat, lon; places: pid (their order), tags, geometry (array of lat,
    lon). Distance is to the nearest vertex; of equal names (in any case) the
    nearest counts, the earlier among equals; bearings run from place to point.
    """
    named = (F.col("kind").isNotNull()) & (F.coalesce("name", F.lit("")) != "")
    return at_spots(points, lambda spots: nearest_of(met_places(spots, named_places(places).where(named), radius), k))


def at_spots(points: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``near`` finds around points (id, lat, lon), asked once a position however many points lie there."""
    spots = points.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    found = near(spots.select(F.struct("lat", "lon").alias("id"), "lat", "lon"))
    found = found.select("*", F.col("id.lat").alias("lat"), F.col("id.lon").alias("lon")).drop("id")
    return points.select("id", "lat", "lon").distinct().join(found, ["lat", "lon"]).select("id", *[c for c in found.columns if c not in ("lat", "lon")])


def named_places(places: DataFrame) -> DataFrame:
    """pid, kind, name and geometry of places, and the columns beside them; kind and name may be null."""
    tag = lambda n: F.try_element_at("tags", F.lit(n))
    return places.withColumn("kind", kind_of(F.col("tags"))).withColumn("name", F.coalesce(F.nullif(tag("name:fr"), F.lit("")), tag("name")))


def met_places(points: DataFrame, places: DataFrame, radius: float, *keep: str) -> DataFrame:
    """id, p_pid and ``x`` (d and both ends) of places with a vertex within ``radius``, and their columns ``keep`` as p_..."""
    rows = places.select("pid", "kind", "name", *keep, F.posexplode("geometry").alias("vertex", "g")).select("pid", "kind", "name", *keep, "vertex", F.col("g.lat").alias("lat"), F.col("g.lon").alias("lon")).where("lat is not null")
    met = radius_join(points.select("id", "lat", "lon"), rows, radius)
    return met.groupBy("id", "p_pid").agg(F.min_by(F.struct("d", "lat", "lon", "p_lat", "p_lon", "p_name", "p_kind"), F.struct("d", "p_vertex")).alias("x"), *[F.first(f"p_{c}").alias(f"p_{c}") for c in keep])


def nearest_of(near: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of met places, one a name: id, place, name, kind, d, b."""
    by_name = Window.partitionBy("id", F.lower("x.p_name")).orderBy("x.d", "p_pid")
    by_distance = Window.partitionBy("id").orderBy("x.d", "p_pid")
    near = near.withColumn("n", F.row_number().over(by_name)).where("n = 1").withColumn("place", F.row_number().over(by_distance)).where(F.col("place") <= k)
    return near.select("id", "place", F.col("x.p_name").alias("name"), F.col("x.p_kind").alias("kind"), F.col("x.d").alias("d"), bearing_deg("x.p_lat", "x.p_lon", "x.lat", "x.lon").alias("b"))


def first_answer(points: DataFrame, *sources: tuple[DataFrame, str]) -> DataFrame:
    """Left lookups by rounded point, in order; the first source with a value answers.

    sources: (table of key and the named column, name of the column).
    """
    out = points.withColumn("key", T.point_key("lat", "lon"))
    names = []
    for i, (source, column) in enumerate(sources):
        names.append(f"answer_{i}")
        out = out.join(source.select("key", F.col(column).alias(names[-1])).dropDuplicates(["key"]), "key", "left")
    return out.withColumn("answer", F.coalesce(*names)).drop(*names)


def pin_fold(xs: list[dict], least: float) -> list[list[int]]:
    """Groups of ordered pins. Seeds lie apart, so a square of side ``least`` holds few and nine squares are looked at."""
    groups: list[list[int]] = []
    squares: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
    for p in xs:
        i, x, y = p["i"], p["x"], p["y"]
        known = least > 0 and x is not None and y is not None and math.isfinite(x / least) and math.isfinite(y / least)
        found = None
        if known:
            u, v = math.floor(x / least), math.floor(y / least)
            for near in ((u + du, v + dv) for du in (-1, 0, 1) for dv in (-1, 0, 1)):
                for g, a, b in squares.get(near, ()):
                    if (found is None or g < found) and math.hypot(a - x, b - y) < least:
                        found = g
        if found is not None:
            groups[found].append(i)
        else:
            if known:
                squares.setdefault((u, v), []).append((len(groups), x, y))
            groups.append([i])
    return groups


def profile_fold(xs: list[dict], least: float) -> list[list[int]]:
    groups: list[list[int]] = []
    seed = None
    for p in xs:
        if seed is not None and p["x"] is not None and p["x"] - seed < least:
            groups[-1].append(p["i"])
        else:
            seed = p["x"]
            groups.append([p["i"]])
    return groups


def folded(rows: DataFrame, keys: tuple[str, ...], fold, least: float) -> DataFrame:
    """keys, grp, ids from keys and xs, the ordered pins of a view."""

    def run(batches):
        for b in batches:
            owner, number, ids = [], [], []
            for at in range(b.num_rows):
                groups = fold(b.column(len(keys))[at].as_py(), least)
                owner += [at] * len(groups)
                number += range(len(groups))
                ids += groups
            columns = [b.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], [*keys, "grp", "ids"])

    rows = rows.select(*keys, "xs")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[: len(keys)], StructField("grp", IntegerType()), StructField("ids", ArrayType(IntegerType()))]))


def pin_groups(pins: DataFrame, least: float = C.PIN_PX, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Greedy groups of overlapping pins: a pin joins the first group whose seed is under ``least`` away.

    pins: keys, i (0-based order), x, y. The fold is ordered, one array a view, and linear in the pins.
    """
    item = F.struct(F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = pins.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return folded(rows, keys, pin_fold, least).select(*keys, "grp", "ids", T.pin_label(F.col("ids")).alias("label"))


def profile_groups(pins: DataFrame, least: float = C.PROFILE_PIN_PX, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Consecutive pins of a profile, each group within ``least`` of its first (keys, i, x)."""
    item = F.struct(F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x"))
    rows = pins.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return folded(rows, keys, profile_fold, least)


def both_view(positions: DataFrame) -> DataFrame:
    """Distinct positions of a view in order: device, current point, then the track (view, ord, lat, lon)."""
    w = Window.partitionBy("view", "lat", "lon").orderBy("ord")
    return positions.where("lat is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def focus_view(points: DataFrame, me: DataFrame) -> DataFrame:
    """The points of a view, and the device where there is exactly one (view, ord, lat, lon; me: view, lat, lon)."""
    single = points.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("ord")).where("n = 1")
    extra = me.join(single, "view").select("view", (F.col("ord") + 1).alias("ord"), "lat", "lon")
    return points.select("view", "ord", "lat", "lon").unionByName(extra)


def nearest_sample(samples: DataFrame, fingers: DataFrame) -> DataFrame:
    """The profile sample nearest each finger's x (samples: track, d; fingers: fid, track, x).

    The next sample on either side is found by one window over both, not by a cross product.
    """
    both = samples.select("track", F.col("d").cast("double").alias("x"), F.lit(None).cast("long").alias("fid")).unionByName(fingers.select("track", F.col("x").cast("double").alias("x"), F.col("fid").cast("long").alias("fid")))
    own = F.when(F.col("fid").isNull(), F.col("x"))
    w = Window.partitionBy("track").orderBy("x", F.col("fid").asc_nulls_first())
    rows = both.withColumns({"before": F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    near = F.when(F.col("after").isNull() | (F.col("x") - F.col("before") <= F.col("after") - F.col("x")), F.col("before")).otherwise(F.col("after"))
    return rows.where("fid is not null").select("fid", "track", near.alias("d"))
