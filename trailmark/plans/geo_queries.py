"""Queries of the column functions, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import geo as G, text as T
from trailmark.plans import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r(c, digits: int = 6):
    return F.round(c, digits)


PAIR = ("lat", "lon", "lat2", "lon2")
PAIRS_SQL = f"WITH {V.WORLD}, p AS (SELECT id, lat, lon, 43.0::DOUBLE + id % 70 / 10.0::DOUBLE AS lat2, -4.0::DOUBLE + id % 130 / 10.0::DOUBLE AS lon2 FROM w)"


def pairs(spark, sf):
    w = V.world(spark, sf)
    return w.withColumns({"lat2": F.lit(43.0) + F.col("id") % 70 / 10.0, "lon2": F.lit(-4.0) + F.col("id") % 130 / 10.0})


@query("geo_haversine", f"{PAIRS_SQL} SELECT id, round({V.hav(*PAIR)}, 3) AS metres FROM p")
def _(spark, sf):
    return pairs(spark, sf).select("id", r(G.haversine_m(*PAIR), 3).alias("metres"))


@query("geo_bearing", f"{PAIRS_SQL} SELECT id, round({V.bear(*PAIR)}, 6) AS bearing FROM p")
def _(spark, sf):
    return pairs(spark, sf).select("id", r(G.bearing_deg(*PAIR)).alias("bearing"))


@query("geo_turn", "SELECT event_id AS id, CAST((event_id * 37 % 360 - event_id * 11 % 360 + 540) % 360 - 180 AS DOUBLE) AS turn FROM events")
def _(spark, sf):
    e = V.read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), G.turn((F.col("event_id") * 37 % 360).cast("double"), (F.col("event_id") * 11 % 360).cast("double")).alias("turn"))


@query("geo_cardinal", "SELECT event_id AS id, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSO','SO','OSO','O','ONO','NO','NNO'][CAST(floor((event_id * 37 % 3600) / 10.0::DOUBLE / 22.5::DOUBLE + 0.5::DOUBLE) AS BIGINT) % 16 + 1] AS wind FROM events")
def _(spark, sf):
    e = V.read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), G.cardinal(F.col("event_id") * 37 % 3600 / 10.0).alias("wind"))


@query("geo_region_flags", f"WITH {V.WORLD} SELECT id, (lat BETWEEN 43.0 AND 48.6 AND lon BETWEEN 4.0 AND 17.0) OR (lat BETWEEN 41.0 AND 51.6 AND lon BETWEEN -5.6 AND 10.0) AS region, abs(lat) <= 90 AND abs(lon) <= 180 AS valid FROM w")
def _(spark, sf):
    return V.world(spark, sf).select("id", G.in_region("lat", "lon").alias("region"), G.valid_position("lat", "lon").alias("valid"))


@query("geo_route_check", f"WITH {V.WORLD}, c AS (SELECT id, CASE WHEN lat BETWEEN 41 AND 51.5 AND lon BETWEEN -5.5 AND 10 THEN 'ok' WHEN lon BETWEEN 41 AND 51.5 AND lat BETWEEN -5.5 AND 10 THEN 'swapped' ELSE 'outside' END AS code FROM w) SELECT id, code, code = 'ok' AS ok, code = 'swapped' AS swap FROM c")
def _(spark, sf):
    return V.world(spark, sf).select("id", G.route_check("lat", "lon").alias("c")).select("id", "c.*")


E2 = "0.0066943799901413165::DOUBLE"
EP2 = "0.006739496742276434::DOUBLE"
UTM_SQL = f"""u1 AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone, radians(lat) AS p FROM w),
u2 AS (SELECT *, radians(lon - ((zone - 1) * 6 - 180 + 3)) AS dl, 6378137.0::DOUBLE / sqrt(1 - {E2} * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, {EP2} * cos(p) * cos(p) AS c FROM u1),
u3 AS (SELECT *, cos(p) * dl AS a, 6378137.0::DOUBLE * ((1 - {E2}/4 - 3*pow({E2},2)/64 - 5*pow({E2},3)/256) * p - (3*{E2}/8 + 3*pow({E2},2)/32 + 45*pow({E2},3)/1024) * sin(2*p) + (15*pow({E2},2)/256 + 45*pow({E2},3)/1024) * sin(4*p) - 35*pow({E2},3)/3072 * sin(6*p)) AS m FROM u2),
u4 AS (SELECT *, 0.9996::DOUBLE * n * (a + (1 - t + c) * pow(a,3)/6 + (5 - 18*t + t*t + 72*c - 58*{EP2}) * pow(a,5)/120) + 500000 AS east,
  0.9996::DOUBLE * (m + n * tan(p) * (a*a/2 + (5 - t + 9*c + 4*c*c) * pow(a,4)/24 + (61 - 58*t + t*t + 600*c - 330*{EP2}) * pow(a,6)/720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS north FROM u3)"""


@query("geo_utm_forward", f"WITH {V.WORLD}, {UTM_SQL} SELECT id, zone, substr('CDEFGHJKLMNPQRSTUVWX', CAST(least(19, greatest(0, floor((lat + 80) / 8))) AS INTEGER) + 1, 1) AS band, round(east, 3) AS east, round(north, 3) AS north FROM u4")
def _(spark, sf):
    w = V.world(spark, sf)
    east, north = G.utm_forward("lat", "lon")
    return w.select("id", G.utm_zone("lon").alias("zone"), G.utm_band("lat").alias("band"), r(east, 3).alias("east"), r(north, 3).alias("north"))


@query("geo_utm_roundtrip", f"WITH {V.WORLD} SELECT id, true AS near FROM w")
def _(spark, sf):
    w = V.world(spark, sf)
    east, north = G.utm_forward("lat", "lon")
    w = w.select("*", G.utm_zone("lon").alias("zone"), G.utm_band("lat").alias("band"), east.alias("east"), north.alias("north"))
    lat, lon = G.utm_inverse("zone", "band", "east", "north")
    return w.select("id", (G.haversine_m("lat", "lon", lat, lon) < 2).alias("near"))


ORI = "alpha, beta, gamma"
ORI_SQL = "WITH o AS (SELECT event_id AS id, CAST(event_id * 37 % 360 AS DOUBLE) AS alpha, CAST(event_id * 13 % 170 - 85 AS DOUBLE) AS beta, CAST(event_id * 7 % 80 - 40 AS DOUBLE) AS gamma, CAST(event_id % 4 * 90 AS DOUBLE) AS screen FROM events)"


def orientation(spark, sf):
    e = F.col("event_id")
    return V.read(spark, sf, "events").select(e.alias("id"), (e * 37 % 360).cast("double").alias("alpha"), (e * 13 % 170 - 85).cast("double").alias("beta"), (e * 7 % 80 - 40).cast("double").alias("gamma"), (e % 4 * 90).cast("double").alias("screen"))


@query(
    "geo_heading",
    f"""{ORI_SQL}, t AS (SELECT id, cos(radians(alpha)) ca, sin(radians(alpha)) sa, cos(radians(beta)) cb, sin(radians(beta)) sb, cos(radians(gamma)) cg, sin(radians(gamma)) sg, cos(radians(screen)) cs, sin(radians(screen)) ss FROM o),
v AS (SELECT id, -cs*sa*cb + ss*(ca*cg - sa*sb*sg) - (ca*sg + sa*sb*cg) AS x, cs*ca*cb + ss*(sa*cg + ca*sb*sg) - (sa*sg - ca*sb*cg) AS y FROM t)
SELECT id, round(x, 9) + 0 AS x, round(y, 9) + 0 AS y FROM v""",
)
def _(spark, sf):
    # compared as a direction, since 0 and 360 are one heading
    h = F.radians(G.heading("alpha", "beta", "gamma", "screen"))
    o = orientation(spark, sf)
    ca, sa, cb, sb, cg, sg, cs, ss = (f(F.radians(c)) for c in ("alpha", "beta", "gamma", "screen") for f in (F.cos, F.sin))
    x, y = -cs * sa * cb + ss * (ca * cg - sa * sb * sg) - (ca * sg + sa * sb * cg), cs * ca * cb + ss * (sa * cg + ca * sb * sg) - (sa * sg - ca * sb * cg)
    size = F.sqrt(x * x + y * y)
    return o.select("id", (F.round(size * F.sin(h), 9) + 0).alias("x"), (F.round(size * F.cos(h), 9) + 0).alias("y"))


@query("geo_pitch", f"{ORI_SQL} SELECT id, round(degrees(asin(greatest(-1, least(1, -cos(radians(beta)) * cos(radians(gamma)))))), 6) AS pitch FROM o")
def _(spark, sf):
    return orientation(spark, sf).select("id", r(G.pitch("beta", "gamma")).alias("pitch"))


@query("geo_sight_angle", "SELECT event_id AS id, round(degrees(atan2((event_id % 3000) - ((event_id * 7 % 2000) + 1.5::DOUBLE) - 0.87::DOUBLE * pow(CAST(event_id * 31 % 20000 + 10 AS DOUBLE), 2) / (2 * 6371000.0::DOUBLE), CAST(event_id * 31 % 20000 + 10 AS DOUBLE))), 6) AS angle FROM events")
def _(spark, sf):
    e = F.col("event_id")
    return V.read(spark, sf, "events").select(e.alias("id"), r(G.sight_angle((e * 31 % 20000 + 10).cast("double"), (e % 3000).cast("double"), (e * 7 % 2000).cast("double"))).alias("angle"))


@query("geo_declination", f"WITH {V.WORLD} SELECT id, round(1 + 0.28::DOUBLE * lon, 6) AS declination FROM w")
def _(spark, sf):
    return V.world(spark, sf).select("id", r(G.declination("lon")).alias("declination"))


@query("geo_slope", "SELECT event_id AS id, CASE WHEN event_id % 500 >= 20 THEN round((event_id % 90 - 45) * 100.0::DOUBLE / (event_id % 500), 6) END AS slope, CASE WHEN abs(event_id % 90 - 45) < 5 THEN 'flat' WHEN event_id % 90 > 45 THEN 'up' ELSE 'down' END AS tag FROM events")
def _(spark, sf):
    e = F.col("event_id")
    return V.read(spark, sf, "events").select(e.alias("id"), r(G.slope_pct(e % 90 - 45, F.nullif((e % 500).cast("double"), F.lit(0.0)))).alias("slope"), G.slope_tag(e % 90 - 45).alias("tag"))


# Degree texts: built from whole thousandths of minutes, halfway between two texts' rounding steps.
@query("fmt_dmm", "SELECT event_id AS id, (CASE WHEN event_id % 2 = 0 THEN 'N ' ELSE 'S ' END) || lpad(CAST(event_id % 90 AS VARCHAR), 2, '0') || '°' || lpad(CAST(event_id * 7919 % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id * 7919 % 1000 AS VARCHAR), 3, '0') || '''' AS text FROM events")
def _(spark, sf):
    e = F.col("event_id")
    v = (e % 90 + (e * 7919 % 60000 + 0.1) / 60000.0) * F.when(e % 2 == 0, 1).otherwise(-1)
    return V.read(spark, sf, "events").select(e.alias("id"), T.dmm_text(v, True).alias("text"))


@query("fmt_dms", """SELECT event_id AS id, (CASE WHEN event_id % 2 = 0 THEN 'E ' ELSE 'O ' END) || lpad(CAST(event_id % 180 AS VARCHAR), 3, '0') || '°' || lpad(CAST(event_id * 7919 % 36000 // 600 AS VARCHAR), 2, '0') || '''' || lpad(CAST(event_id * 7919 % 600 // 10 AS VARCHAR), 2, '0') || '.' || CAST(event_id * 7919 % 10 AS VARCHAR) || '"' AS text FROM events""")
def _(spark, sf):
    e = F.col("event_id")
    v = (e % 180 + (e * 7919 % 36000 + 0.1) / 36000.0) * F.when(e % 2 == 0, 1).otherwise(-1)
    return V.read(spark, sf, "events").select(e.alias("id"), T.dms_text(v, False).alias("text"))


@query("fmt_pilot", "SELECT event_id AS id, (CASE WHEN event_id % 2 = 0 THEN '' ELSE '-' END) || CAST(event_id % 90 AS VARCHAR) AS d, CAST(event_id * 7919 % 600000 // 10000 AS VARCHAR) || '.' || lpad(CAST(event_id * 7919 % 10000 AS VARCHAR), 4, '0') AS m FROM events")
def _(spark, sf):
    e = F.col("event_id")
    v = (e % 90 + (e * 7919 % 600000 + 0.1) / 600000.0) * F.when(e % 2 == 0, 1).otherwise(-1)
    return V.read(spark, sf, "events").select(e.alias("id"), T.pilot_entry(v).alias("p")).select("id", "p.*")


@query("fmt_distance", "WITH m AS (SELECT event_id AS id, event_id * 7919 % 30000 AS d FROM events) SELECT id, CASE WHEN d < 1000 THEN CAST(d AS VARCHAR) || ' m' WHEN d < 10000 THEN CAST((d // 10 + CASE WHEN d % 10 >= 5 THEN 1 ELSE 0 END) // 100 AS VARCHAR) || ',' || lpad(CAST((d // 10 + CASE WHEN d % 10 >= 5 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0') || ' km' ELSE CAST((d // 100 + CASE WHEN d % 100 >= 50 THEN 1 ELSE 0 END) // 10 AS VARCHAR) || ',' || CAST((d // 100 + CASE WHEN d % 100 >= 50 THEN 1 ELSE 0 END) % 10 AS VARCHAR) || ' km' END AS text FROM m")
def _(spark, sf):
    e = F.col("event_id")
    return V.read(spark, sf, "events").select(e.alias("id"), T.distance_text((e * 7919 % 30000).cast("double")).alias("text"))


@query("fmt_duration", "WITH m AS (SELECT event_id AS id, event_id * 7919 % 5000 - 50 AS m FROM events) SELECT id, CASE WHEN m <= 0 THEN '0 min' WHEN m >= 1440 THEN CAST(m // 1440 AS VARCHAR) || ' j ' || CAST(m // 60 % 24 AS VARCHAR) || ' h' WHEN m >= 60 THEN CAST(m // 60 AS VARCHAR) || ' h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') ELSE CAST(m AS VARCHAR) || ' min' END AS text FROM m")
def _(spark, sf):
    e = F.col("event_id")
    return V.read(spark, sf, "events").select(e.alias("id"), T.duration_text((e * 7919 % 5000 - 50) * 60000).alias("text"))


@query("fmt_speed", "WITH m AS (SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN event_id * 31 % 5000 END AS v FROM events) SELECT id, CASE WHEN v IS NULL THEN '' WHEN v < 1000 THEN CAST(v AS VARCHAR) || ' m/h' ELSE CAST((v // 100 + CASE WHEN v % 100 >= 50 THEN 1 ELSE 0 END) // 10 AS VARCHAR) || ',' || CAST((v // 100 + CASE WHEN v % 100 >= 50 THEN 1 ELSE 0 END) % 10 AS VARCHAR) || ' km/h' END AS text FROM m")
def _(spark, sf):
    e = F.col("event_id")
    return V.read(spark, sf, "events").select(e.alias("id"), T.speed_text(F.when(e % 11 != 0, (e * 31 % 5000).cast("double"))).alias("text"))


@query("fmt_delta", "WITH m AS (SELECT event_id AS id, event_id * 31 % 5001 - 2500 AS d FROM events) SELECT id, CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '−' ELSE '±' END || CASE WHEN abs(d) >= 1000 THEN CAST(abs(d) // 1000 AS VARCHAR) || chr(8239) || lpad(CAST(abs(d) % 1000 AS VARCHAR), 3, '0') ELSE CAST(abs(d) AS VARCHAR) END || ' m' AS text FROM m")
def _(spark, sf):
    e = F.col("event_id")
    return V.read(spark, sf, "events").select(e.alias("id"), T.delta_text((e * 31 % 5001 - 2500).cast("double")).alias("text"))


@query("fmt_all_positions")
def _(spark, sf):
    return V.world(spark, sf).select("id", T.all_formats("lat", "lon").alias("formats"), T.share_message("lat", "lon").alias("message"), T.links("lat", "lon").alias("l"), T.edit_lines("lat", "lon", F.element_at(F.array(*map(F.lit, ("UTM 32T", "DMS", "NMEA", "DD"))), (F.col("id") % 4 + 1).cast("int"))).alias("lines")).select("id", "formats", "message", "l.route", "l.geo", "lines")
