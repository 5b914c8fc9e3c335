"""What is known of a place: altitude, municipality, named places, and the lines that tell it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark import constants as C
from trailmark.functions import text as T
from trailmark.operators.spatial import at_spots, met_places, named_places, nearest_of

# Address levels in the order in which they name a municipality, and the tags of wanted places.
LEVELS = ["city", "town", "village", "municipality", "hamlet"]
NATURAL_NODES = ["peak", "saddle", "waterfall", "spring", "cave_entrance"]
TOURISM_NODES = ["alpine_hut", "wilderness_hut"]
PLACE_NODES = ["hamlet", "village", "locality", "isolated_dwelling"]
NATURAL_WAYS = ["water", "glacier"]
LOWEST_M = -1000.0
MOST_NODES, MOST_WAYS = 80, 15


def _text(address: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(address, F.lit(key)), F.lit(""))


def municipality_of(address: Column) -> Column:
    """struct(name, country) of an address map; the country only outside France, null without a name."""
    name = F.coalesce(*[_text(address, k) for k in LEVELS])
    abroad = F.coalesce(_text(address, "country_code") != "fr", F.lit(False))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.when(abroad, F.coalesce(_text(address, "country"), F.lit(""))).otherwise("").alias("country")))


def finite(z: Column) -> Column:
    return F.when(~F.isnan(z) & (F.abs(z) != float("inf")), z)


def altitude_of(points: DataFrame, model: DataFrame, world: DataFrame) -> DataFrame:
    """Points with ``z`` and ``z_source``: the model's altitude unless missing or below its least value, else the world's.

    model, world: key (``point_key``), z.
    """
    own = model.select("key", F.when(finite(F.col("z")) >= LOWEST_M, F.col("z")).alias("z_model")).dropDuplicates(["key"])
    other = world.select("key", finite(F.col("z")).alias("z_world")).dropDuplicates(["key"])
    out = points.withColumn("key", T.point_key("lat", "lon")).join(own, "key", "left").join(other, "key", "left")
    source = F.when(F.col("z_model").isNotNull(), "model").when(F.col("z_world").isNotNull(), "world")
    return out.withColumns({"z": F.coalesce("z_model", "z_world"), "z_source": source}).drop("key", "z_model", "z_world")


def wanted(kind: Column, tags: Column) -> Column:
    """Whether a map element is a named place that a search around a point asks for."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    flags = [tag("natural").isin(NATURAL_NODES), tag("mountain_pass") == "yes", tag("waterway") == "waterfall", tag("tourism").isin(TOURISM_NODES), tag("place").isin(PLACE_NODES)]
    node = F.array_contains(F.array(*[F.coalesce(f, F.lit(False)) for f in flags]), True)
    way = F.coalesce(tag("natural").isin(NATURAL_WAYS), F.lit(False))
    return tag("name").isNotNull() & (((kind == "node") & node) | ((kind == "way") & way))


def searched(elements: DataFrame) -> DataFrame:
    """The elements that a search returns: of each point's wanted ones the first nodes and ways by id, to their limits.

    elements: id (the point), kind, eid, tags.
    """
    rows = elements.where(wanted(F.col("kind"), F.col("tags")))
    rank = F.row_number().over(Window.partitionBy("id", "kind").orderBy("eid"))
    most = F.when(F.col("kind") == "node", MOST_NODES).otherwise(MOST_WAYS)
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def search_near(points: DataFrame, elements: DataFrame, k: int = 3, radius: float = C.PLACE_RADIUS_M, *, nodes: int = MOST_NODES, ways: int = MOST_WAYS) -> DataFrame:
    """The ``k`` nearest named places among what a search around each point returns: id, place, name, kind, d, b.

    points: id, lat, lon; elements: eid, element (node or way), tags, geometry. A search returns the wanted elements within
    ``radius``, the first ``nodes`` nodes and ``ways`` ways by id; those that are no place count there and go afterwards.
    """
    rows = named_places(elements.where(wanted(F.col("element"), F.col("tags"))).withColumnRenamed("eid", "pid"))

    def near(spots: DataFrame) -> DataFrame:
        met = met_places(spots, rows, radius, "element")
        rank = F.row_number().over(Window.partitionBy("id", "p_element").orderBy("p_pid"))
        met = met.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("p_element") == "node", nodes).otherwise(ways)).drop("rank")
        return nearest_of(met.where("x.p_kind is not null and coalesce(x.p_name, '') <> ''"), k)

    return at_spots(points, near)


def search_with_fallback(points: DataFrame, first: DataFrame, second: DataFrame, failed: DataFrame, k: int = 3, **options) -> DataFrame:
    """``search_near`` by a first source, and by a second for the points (``failed``: id) that it gave no answer for."""
    again = points.join(failed.select("id"), "id", "left_semi")
    answered = points.join(failed.select("id"), "id", "left_anti")
    return search_near(answered, first, k, **options).unionByName(search_near(again, second, k, **options))


def place_lines(points: DataFrame, municipalities: DataFrame, altitudes: DataFrame, near: DataFrame) -> DataFrame:
    """id, text: municipality, altitude and nearest named place, each on a line if known.

    municipalities: id, name, department, country; altitudes: id, z; near: what ``nearest_places`` returns.
    """
    first = near.where("place = 1").select("id", "name", "kind", "d", "b")
    town = municipalities.select("id", F.concat(F.lit("Commune : "), T.municipality_text("name", "department", "country")).alias("town"))
    height = altitudes.select("id", F.concat(F.lit("Altitude : "), T.altitude_text(F.col("z"))).alias("height"))
    line = F.concat(F.lit("Près de : "), "name", F.lit(" ("), "kind", F.lit(", "), T.place_phrase("d", "b"), F.lit(")"))
    out = points.select("id").join(town, "id", "left").join(height, "id", "left").join(first.select("id", line.alias("near")), "id", "left")
    return out.select("id", F.concat_ws("\n", "town", "height", "near").alias("text"))
