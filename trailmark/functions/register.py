"""SQL names for the column functions: temporary functions and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from trailmark import constants as C
from trailmark.operators.parse import RESULT, _parse, parse

HAVERSINE = "2 * {r} * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
BEARING = "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360D, 360D)"
FOUR = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"


class ParsePositions:
    """One row a position of a text: rank 0 is the best, others are alternatives."""

    def eval(self, text: str):
        p = parse(text)
        for rank, c in enumerate([p["best"], *p["alts"]] if p["ok"] else []):
            yield rank, c["lat"], c["lon"], c["fmt"], c["score"], c["seg"]


def register(spark: SparkSession) -> None:
    """haversine_m, bearing_deg, in_region, turn_deg, parse_position and parse_positions in SQL."""
    inside = lambda b: f"(lat BETWEEN {b[0]} AND {b[1]} AND lon BETWEEN {b[2]} AND {b[3]})"
    known = f"CASE WHEN lat1 IS NOT NULL AND lon1 IS NOT NULL AND lat2 IS NOT NULL AND lon2 IS NOT NULL THEN {HAVERSINE.format(r=f'{C.SPHERE_M}D')} END"
    for name, arguments, kind, body in (
        ("haversine_m", FOUR, "DOUBLE", known), ("bearing_deg", FOUR, "DOUBLE", BEARING), ("in_region", "lat DOUBLE, lon DOUBLE", "BOOLEAN", f"{inside(C.ALPS)} OR {inside(C.FRANCE)}"),
        ("turn_deg", "target DOUBLE, heading DOUBLE", "DOUBLE", "pmod(target - heading + 180D, 360D) - 180D"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udf.register("parse_position", pandas_udf(_parse, RESULT))
    spark.udtf.register("parse_positions", udtf(ParsePositions, returnType="rank int, lat double, lon double, fmt string, score double, seg string"))
