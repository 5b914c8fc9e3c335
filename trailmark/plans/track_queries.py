"""Queries of the track operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import track as K
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


def r(c, digits: int = 3):
    return F.round(c, digits)


SPEED = "CASE WHEN {dt} >= 600000 THEN round({m} * 3600000.0::DOUBLE / {dt}, 3) END"


@query("track_legs", f"WITH {V.LEGS} SELECT track, seq, i, round(d, 3) AS d, round(b, 3) AS b, dt, {SPEED.format(dt='dt', m='d')} AS v FROM g WHERE i > 0")
def _(spark, sf):
    return K.legs(V.sightings(spark, sf)).select("track", "seq", F.col("i").cast("long").alias("i"), r("d").alias("d"), r("b").alias("b"), "dt", r("v").alias("v"))


@query(
    "track_stats",
    f"""WITH {V.LEGS}, a AS (SELECT track, count(*) AS n, coalesce(sum(d), 0) AS total, arg_min(lat, (t, seq)) AS la, arg_min(lon, (t, seq)) AS lo, arg_max(lat, (t, seq)) AS lz, arg_max(lon, (t, seq)) AS oz, max(ms) - min(ms) AS dt, arg_max(coalesce(d, -1), (t, seq)) AS last_d FROM g GROUP BY 1)
SELECT track, n, round(total, 3) AS total, dt, {SPEED.format(dt='dt', m='total')} AS v, CASE WHEN n > 1 THEN round({V.hav('la', 'lo', 'lz', 'oz')}, 3) ELSE 0 END AS direct, CASE WHEN n > 1 THEN round({V.bear('la', 'lo', 'lz', 'oz')}, 3) END AS bearing, round(nullif(last_d, -1), 3) AS last_d FROM a""",
)
def _(spark, sf):
    s = K.summary(V.sightings(spark, sf))
    return s.select("track", "n", *[r(c).alias(c) for c in ("total",)], "dt", *[r(c).alias(c) for c in ("v", "direct", "bearing", "last_d")])


@query("track_rank", f"WITH {V.SIGHTINGS} SELECT track, seq, row_number() OVER (PARTITION BY track ORDER BY t, seq) AS rank FROM s")
def _(spark, sf):
    return K.ranked(V.sightings(spark, sf)).select("track", "seq", F.col("rank").cast("long").alias("rank"))


@query("track_last_point", f"WITH {V.SIGHTINGS} SELECT track, arg_max(lat, (t, seq)) AS lat, arg_max(lon, (t, seq)) AS lon, arg_max(seq, (t, seq)) AS seq FROM s GROUP BY 1")
def _(spark, sf):
    return K.last_points(V.sightings(spark, sf)).select("track", "lat", "lon", "seq")


@query("path_cumdist", f"WITH {V.LEGS} SELECT track, seq, round(sum(coalesce(d, 0)) OVER (PARTITION BY track ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 2) AS cum FROM g")
def _(spark, sf):
    return K.with_distance(V.sightings(spark, sf)).select("track", "seq", r("cum", 2).alias("cum"))


def second_track(spark, sf):
    """Half of the sightings again: some as they were, some moved by metres or minutes."""
    e = F.col("seq")
    s = V.sightings(spark, sf).where(e % 2 == 0)
    kind = e / 2 % 4
    shift = F.when(kind == 1, 0.00001).when(kind == 2, 0.01).otherwise(0.0)
    late = F.when(kind == 3, 120).otherwise(20)
    return s.select("track", (e + 10_000_000).alias("seq"), (F.col("t") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), late.cast("decimal(18,6)"))).alias("t"), (F.col("lat") + shift).alias("lat"), "lon", "label")


SECOND = "q AS (SELECT track, seq + 10000000 AS seq, ms + CASE WHEN seq // 2 % 4 = 3 THEN 120000 ELSE 20000 END AS ms, lat + CASE seq // 2 % 4 WHEN 1 THEN 0.00001::DOUBLE WHEN 2 THEN 0.01::DOUBLE ELSE 0 END AS lat, lon FROM s WHERE seq % 2 = 0)"


@query("track_merge", f"WITH {V.SIGHTINGS}, {SECOND} SELECT track, seq, 'a' AS origin FROM s UNION ALL SELECT track, seq, 'b' FROM q WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.track = q.track AND abs(s.ms - q.ms) < 60000 AND {V.hav('s.lat', 's.lon', 'q.lat', 'q.lon')} < 3)")
def _(spark, sf):
    s = V.sightings(spark, sf)
    return K.merge(s.select("track", "seq", "t", "lat", "lon", "label"), second_track(spark, sf)).select("track", "seq", "origin")


def keyed(spark, sf):
    e = F.col("seq")
    points = V.sightings(spark, sf).select("track", "seq", "t", "lat", "lon", F.when(e % 5 == 0, F.concat(F.lit("k"), e.cast("string"))).alias("key"))
    q = second_track(spark, sf).withColumn("o", e - 10_000_000)
    q = q.select(F.col("seq").alias("qid"), "track", "t", "lat", "lon", F.when(F.col("o") % 3 == 0, F.concat(F.lit("k"), F.col("o").cast("string"))).alias("key"), (F.col("o") % 7 == 0).alias("dated"))
    return points, q


KEYED = f"""WITH {V.SIGHTINGS}, {SECOND},
p AS (SELECT track, seq, ms, lat, lon, CASE WHEN seq % 5 = 0 THEN 'k' || CAST(seq AS VARCHAR) END AS key, row_number() OVER (PARTITION BY track ORDER BY t, seq) AS rank FROM s),
z AS (SELECT seq AS qid, track, ms, lat, lon, CASE WHEN (seq - 10000000) % 3 = 0 THEN 'k' || CAST(seq - 10000000 AS VARCHAR) END AS key, (seq - 10000000) % 7 = 0 AS dated FROM q),
n AS (SELECT qid, min(rank) AS near, arg_min(p.seq, rank) AS near_seq, arg_min(coalesce(p.key, ''), rank) AS near_key FROM z JOIN p ON p.track = z.track AND abs(p.ms - z.ms) < 60000 AND {V.hav('p.lat', 'p.lon', 'z.lat', 'z.lon')} < 3 GROUP BY 1)"""


@query("track_find_point", f"{KEYED} SELECT z.qid, z.track, coalesce(p.rank, n.near, 0) AS rank FROM z LEFT JOIN p ON p.track = z.track AND p.key = z.key LEFT JOIN n ON n.qid = z.qid")
def _(spark, sf):
    return K.find_points(*keyed(spark, sf)).select("qid", "track", F.col("rank").cast("long").alias("rank"))


@query(
    "track_place_point",
    f"""{KEYED} SELECT z.qid, z.track, CASE WHEN p.seq IS NOT NULL THEN CASE WHEN {V.hav('p.lat', 'p.lon', 'z.lat', 'z.lon')} < 0.5 AND NOT (z.dated AND p.ms <> z.ms) THEN 'same' ELSE 'moved' END WHEN n.near IS NOT NULL THEN 'dup' ELSE 'added' END AS how,
coalesce(p.seq, n.near_seq) AS seq, CASE WHEN p.seq IS NOT NULL AND NOT z.dated THEN p.ms ELSE z.ms END AS ms, p.seq IS NULL AND n.near IS NOT NULL AND z.key IS NOT NULL AND near_key = '' AS adopts_key
FROM z LEFT JOIN p ON p.track = z.track AND p.key = z.key LEFT JOIN n ON n.qid = z.qid""",
)
def _(spark, sf):
    return K.place_points(*keyed(spark, sf)).select("qid", "track", "how", "seq", F.unix_millis("t").alias("ms"), "adopts_key")


@query(
    "track_reorder_dates",
    f"""WITH {V.SIGHTINGS}, m AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY seq) AS place, seq, ms, ms - CASE WHEN seq % 2 = 0 THEN 86400000 ELSE 0 END AS ms0, seq % 3 = 0 AS moved FROM s),
n AS (SELECT *, lag(ms) OVER o AS a, lead(ms) OVER o AS b FROM m WINDOW o AS (PARTITION BY track ORDER BY place)), f AS (SELECT *, coalesce(a <= ms0, true) AND coalesce(ms0 <= b, true) AS fits FROM n)
SELECT track, place, CASE WHEN NOT moved THEN ms WHEN fits THEN ms0 WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a < b THEN (a + b) // 2 ELSE a + 60000 END WHEN a IS NOT NULL THEN a + 60000 WHEN b IS NOT NULL THEN b - 60000 ELSE ms END AS ms, CASE WHEN moved AND NOT fits THEN 'moved' ELSE 'kept' END AS src FROM f""",
)
def _(spark, sf):
    from pyspark.sql import Window

    s = V.sightings(spark, sf)
    place = F.row_number().over(Window.partitionBy("track").orderBy("seq"))
    t0 = F.col("t") - F.make_dt_interval(F.when(F.col("seq") % 2 == 0, 1).otherwise(0).cast("int"))
    rows = s.select("track", place.cast("long").alias("place"), "t", t0.alias("t0"), (F.col("seq") % 3 == 0).alias("moved"))
    return K.moved_dates(rows)


@query(
    "path_samples",
    f"""WITH {V.LEGS}, t AS (SELECT *, sum(coalesce(d, 0)) OVER (PARTITION BY track) AS total, greatest(0, 200 - count(*) OVER (PARTITION BY track)) AS extra, sum(coalesce(d, 0)) OVER (PARTITION BY track ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS cum FROM g),
m AS (SELECT *, CASE WHEN i > 0 AND total > 0 THEN CAST(floor(extra * d / total + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS m FROM t), j AS (SELECT *, unnest(generate_series(1, m + 1)) AS j FROM m)
SELECT track, i, j, CASE WHEN j = m + 1 THEN i ELSE -1 END AS k, round(CASE WHEN j = m + 1 THEN lat ELSE plat + (lat - plat) * (j / CAST(m + 1 AS DOUBLE)) END, 6) AS lat, round(CASE WHEN j = m + 1 THEN cum ELSE cum - d + d * (j / CAST(m + 1 AS DOUBLE)) END, 2) AS d FROM j""",
)
def _(spark, sf):
    s = K.path_samples(V.sightings(spark, sf), 200)
    return s.select("track", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"), r("lat", 6).alias("lat"), r("d", 2).alias("d"))


@query("climb_totals", f"WITH {V.LEGS} SELECT track, coalesce(sum(CASE WHEN z > pz THEN z - pz END), 0) AS up, coalesce(sum(CASE WHEN z < pz THEN pz - z END), 0) AS down FROM g GROUP BY 1")
def _(spark, sf):
    return K.climb_totals(V.sightings(spark, sf))


@query("leg_slope", f"WITH {V.LEGS} SELECT track, i, z - pz AS dz, CASE WHEN d >= 20 THEN round((z - pz) * 100 / d, 4) END AS slope, CASE WHEN z IS NULL OR pz IS NULL THEN NULL WHEN abs(z - pz) < 5 THEN 'flat' WHEN z > pz THEN 'up' ELSE 'down' END AS tag FROM g WHERE i > 0")
def _(spark, sf):
    return K.leg_slopes(V.sightings(spark, sf)).select("track", F.col("i").cast("long").alias("i"), "dz", r("slope", 4).alias("slope"), "tag")


@query(
    "profile_scale",
    f"""WITH {V.SIGHTINGS}, a AS (SELECT track, min(z) AS low, max(z) AS high FROM s GROUP BY 1), b AS (SELECT *, greatest(high - low, 20) AS span FROM a), c AS (SELECT *, span / 4 AS raw, pow(10, floor(log10(greatest(span / 4, 1)))) AS p FROM b)
SELECT track, low, high, span, CASE WHEN p >= raw THEN p WHEN 2 * p >= raw THEN 2 * p WHEN 5 * p >= raw THEN 5 * p WHEN 10 * p >= raw THEN 10 * p END AS step FROM c""",
)
def _(spark, sf):
    return K.profile_scale(V.sightings(spark, sf))


@query(
    "altitude_pack_fallback",
    f"""WITH {V.SIGHTINGS}, p AS (SELECT track, seq, z, (row_number() OVER (PARTITION BY track ORDER BY seq) - 1) // 10 AS pack FROM s), w AS (SELECT *, bool_and(seq % 13 <> 0 AND seq % 29 <> 0) OVER (PARTITION BY track, pack) AS whole FROM p)
SELECT track, seq, pack, CASE WHEN whole THEN z ELSE CAST(seq * 37 % 2500 + 1 AS DOUBLE) END AS z, CASE WHEN whole THEN 'first' ELSE 'second' END AS source FROM w""",
)
def _(spark, sf):
    # sources that are keyed by the points' own cache keys; equal keys are kept apart by the sequence number
    s = V.sightings(spark, sf)
    one = s.where("z is not null and seq % 29 <> 0").select(F.col("seq").cast("string").alias("key"), "z")
    two = s.select(F.col("seq").cast("string").alias("key"), (F.col("seq") * 37 % 2500 + 1).cast("double").alias("z"))
    rows = s.select("track", "seq", "lat", "lon")
    return K.pack_fallback(rows, one, two, 10, key=F.col("seq").cast("string")).select("track", "seq", F.col("pack").cast("long").alias("pack"), "z", "source")


@query(
    "history_last10",
    f"""WITH {V.SIGHTINGS}, k AS (SELECT track AS owner, CAST(seq % 17 AS VARCHAR) AS k, ms, seq, row_number() OVER (PARTITION BY track, seq % 17 ORDER BY t DESC, seq DESC) AS n, t FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY t DESC, seq DESC) AS place FROM k WHERE n = 1) SELECT owner, place, k, ms FROM p WHERE place <= 10""",
)
def _(spark, sf):
    s = V.sightings(spark, sf)
    rows = s.select(F.col("track").alias("owner"), (F.col("seq") % 17).cast("string").alias("k"), F.lit("text").alias("src"), "t", "seq")
    return K.history(rows).select("owner", F.col("place").cast("long").alias("place"), "k", F.unix_millis("t").alias("ms"))


@query("track_link_encode", f"WITH {V.SIGHTINGS} SELECT track, 's=track%20' || CAST(track AS VARCHAR) || string_agg('~' || format('{{:.6f}}', lat) || ',' || format('{{:.6f}}', lon) || ',' || CAST((ms + 500) // 1000 AS VARCHAR) || ',' || coalesce(label, ''), '' ORDER BY t, seq) AS hash FROM s GROUP BY 1")
def _(spark, sf):
    return K.encode_links(V.sightings(spark, sf))


@query("track_link_decode", f"WITH {V.SIGHTINGS} SELECT track AS id, 'track ' || CAST(track AS VARCHAR) AS name, row_number() OVER (PARTITION BY track ORDER BY t, seq) - 1 AS seq, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(label, '') AS label, (ms + 500) // 1000 * 1000 AS t FROM s")
def _(spark, sf):
    links = K.encode_links(V.sightings(spark, sf)).withColumnRenamed("track", "id")
    return K.decode_links(links).select("id", "name", F.col("seq").cast("long").alias("seq"), r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), "label", "t")


@query(
    "track_gpx",
    f"""WITH {V.SIGHTINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, seq) AS rank, 'lat="' || format('{{:.6f}}', lat) || '" lon="' || format('{{:.6f}}', lon) || '"><time>' || strftime(t, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'Z</time>' AS head FROM s)
    SELECT track, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="trailmark" xmlns="http://www.topografix.com/GPX/1/1">' || chr(10) || '  <metadata><name>track ' || CAST(track AS VARCHAR) || '</name></metadata>' || chr(10)
      || string_agg('  <wpt ' || head || '<name>' || CAST(rank AS VARCHAR) || CASE WHEN coalesce(label, '') <> '' THEN ' · ' || label ELSE '' END || '</name></wpt>', chr(10) ORDER BY rank) || chr(10) || '  <trk><name>track ' || CAST(track AS VARCHAR) || '</name><trkseg>' || chr(10)
      || string_agg('      <trkpt ' || head || '</trkpt>', chr(10) ORDER BY rank) || chr(10) || '    </trkseg></trk>' || chr(10) || '</gpx>' || chr(10) AS gpx FROM n GROUP BY 1""",
)
def _(spark, sf):
    return K.to_gpx(V.sightings(spark, sf))


@query("gpx_roundtrip", f"WITH {V.SIGHTINGS} SELECT track AS id, 'track ' || CAST(track AS VARCHAR) AS name, row_number() OVER (PARTITION BY track ORDER BY t, seq) - 1 AS seq, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(label, '') AS label, ms AS t FROM s")
def _(spark, sf):
    files = K.to_gpx(V.sightings(spark, sf)).withColumnRenamed("track", "id")
    return K.from_gpx(files).select("id", "name", F.col("seq").cast("long").alias("seq"), r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), "label", "t")


@query("track_message")
def _(spark, sf):
    return K.messages(V.sightings(spark, sf))


@query(
    "import_policy",
    "SELECT c_custkey AS track, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 = 0 OR c_custkey % 3 = c_custkey % 2 THEN 'merge' ELSE 'replace' END AS policy FROM customer",
)
def _(spark, sf):
    k = F.col("c_custkey")
    c = V.read(spark, sf, "customer")
    current = c.select(k.alias("track"), F.concat(F.lit("n"), (k % 3).cast("string")).alias("name"), F.when(k % 5 == 0, 0).otherwise(3).alias("n"))
    incoming = c.select(k.alias("track"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("n"), (k % 2).cast("string"))).alias("name"), F.lit(2).alias("n"))
    return K.import_tracks(current, incoming)


#: The rank of one placed point a track, for the query of that name in another module.
PUT_RANK = f"""{KEYED}, o AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY track ORDER BY qid) = 1),
pl AS (SELECT o.qid, o.track, CASE WHEN p.seq IS NOT NULL THEN CASE WHEN {V.hav('p.lat', 'p.lon', 'o.lat', 'o.lon')} < 0.5 AND NOT (o.dated AND p.ms <> o.ms) THEN 'same' ELSE 'moved' END WHEN n.near IS NOT NULL THEN 'dup' ELSE 'added' END AS how,
  coalesce(p.seq, n.near_seq) AS seq, CASE WHEN p.seq IS NOT NULL AND NOT o.dated THEN p.ms WHEN p.seq IS NULL AND n.near IS NOT NULL THEN d.ms ELSE o.ms END AS ms FROM o LEFT JOIN p ON p.track = o.track AND p.key = o.key LEFT JOIN n ON n.qid = o.qid LEFT JOIN p d ON d.track = o.track AND d.seq = n.near_seq)
SELECT pl.qid, pl.track, pl.how, 1 + count(x.seq) AS rank FROM pl LEFT JOIN p x ON x.track = pl.track AND (pl.seq IS NULL OR x.seq <> pl.seq) AND (x.ms < pl.ms OR (x.ms = pl.ms AND (pl.seq IS NULL OR x.seq < pl.seq))) GROUP BY ALL"""
ORACLES["put_point_rank"] = PUT_RANK
