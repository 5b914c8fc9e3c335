"""Queries of the request state machines, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.plans import views as V
from trailmark.streaming import requests as R

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def relief_events(spark, sf):
    """Each sighting shows a path, which changes every few, and every second is followed by an answer to one of the last shows."""
    s = V.sightings(spark, sf)
    q = F.col("seq")
    show = s.select(F.col("track").alias("owner"), (q * 10).alias("seq"), "t", F.lit("show").alias("kind"), F.concat(F.lit("path "), F.floor(q / 700).cast("string")).alias("sig"), (q % 9 != 0).alias("online"), F.lit(None).cast("long").alias("req"), F.lit(None).cast("boolean").alias("ok"))
    from pyspark.sql import Window

    before = F.lag(q * 10, 1).over(Window.partitionBy("track").orderBy("t", "seq"))
    answer = s.select(F.col("track").alias("owner"), (q * 10 + 5).alias("seq"), "t", F.lit("answer").alias("kind"), F.lit(None).cast("string").alias("sig"), F.lit(None).cast("boolean").alias("online"), F.when(q % 4 == 0, F.coalesce(before, q * 10)).otherwise(q * 10).alias("req"), (q % 3 != 0).alias("ok"))
    return show.unionByName(answer.where("(seq - 5) / 10 % 2 = 0"))


RELIEF_SQL = f"""WITH RECURSIVE {V.SIGHTINGS}, l AS (SELECT *, lag(seq) OVER (PARTITION BY track ORDER BY t, seq) AS back FROM s),
e AS (SELECT track AS owner, seq * 10 AS seq, t, true AS shown, 'path ' || CAST(seq // 700 AS VARCHAR) AS sig, seq % 9 <> 0 AS online, NULL::BIGINT AS req, NULL::BOOLEAN AS ok FROM l
  UNION ALL SELECT track, seq * 10 + 5, t, false, NULL, NULL, CASE WHEN seq % 4 = 0 THEN coalesce(back, seq) ELSE seq END * 10, seq % 3 <> 0 FROM l WHERE seq % 2 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY t, seq) AS n FROM e),
r(owner, n, seq, sig, here, open, how) AS (SELECT owner, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, '', NULL::BIGINT, '' FROM o WHERE n = 1
  UNION ALL SELECT o.owner, o.n, o.seq, o.sig,
    CASE WHEN shown AND o.sig <> r.here THEN o.sig WHEN NOT shown AND coalesce(o.req = r.open, false) AND NOT ok THEN '' ELSE r.here END,
    CASE WHEN shown AND o.sig <> r.here THEN CASE WHEN online THEN o.seq END WHEN NOT shown AND coalesce(o.req = r.open, false) THEN NULL ELSE r.open END,
    CASE WHEN shown THEN CASE WHEN o.sig = r.here THEN 'kept' WHEN online THEN 'ask' ELSE 'unknown' END WHEN NOT coalesce(o.req = r.open, false) THEN 'stale' WHEN ok THEN 'known' ELSE 'failed' END
  FROM r JOIN o ON o.owner = r.owner AND o.n = r.n + 1)
SELECT owner, seq, sig, how FROM r WHERE n > 0"""


@query("relief_requests", RELIEF_SQL)
def _(spark, sf):
    return R.relief_requests_table(relief_events(spark, sf))


def history_events(spark, sf):
    """Points, every sixth of them a flush and every tenth a cancel."""
    s = V.sightings(spark, sf)
    q = F.col("seq")
    return s.select(F.col("track").alias("owner"), "seq", "t", F.when(q % 6 == 0, "flush").when(q % 10 == 0, "cancel").otherwise("point").alias("kind"))


RECORDED_SQL = f"""WITH {V.SIGHTINGS}, e AS (SELECT track AS owner, seq, ms, t, CASE WHEN seq % 6 = 0 THEN 'flush' WHEN seq % 10 = 0 THEN 'cancel' ELSE 'point' END AS kind FROM s),
n AS (SELECT *, lead(kind) OVER w AS next, lead(ms) OVER w AS next_ms FROM e WINDOW w AS (PARTITION BY owner ORDER BY t, seq)),
r AS (SELECT owner, seq, CASE WHEN next_ms IS NULL OR next_ms - ms >= 86400000 THEN ms + 86400000 ELSE next_ms END AS ms FROM n WHERE kind = 'point' AND (next_ms IS NULL OR next_ms - ms >= 86400000 OR next = 'flush'))"""


@query("history_recorded", f"{RECORDED_SQL} SELECT owner, seq, ms FROM r")
def _(spark, sf):
    return R.recorded(history_events(spark, sf), 86400.0)


@query(
    "history_places",
    f"""{RECORDED_SQL}, k AS (SELECT owner, 'k' || CAST(seq % 7 AS VARCHAR) AS k, max(struct_pack(ms := ms, seq := seq)) AS x FROM r GROUP BY 1, 2)
    SELECT * FROM (SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY x.ms DESC, x.seq DESC) AS INTEGER) AS place, k, 'text ' || CAST(x.seq AS VARCHAR) AS src, x.ms AS ms FROM k) WHERE place <= 3""",
)
def _(spark, sf):
    r = R.recorded(history_events(spark, sf), 86400.0)
    rows = r.select("owner", "seq", "ms", F.concat(F.lit("k"), (F.col("seq") % 7).cast("string")).alias("k"), F.concat(F.lit("text "), F.col("seq").cast("string")).alias("src"))
    return R.history_of(rows, 3)


@query(
    "service_memo_reach",
    f"""WITH RECURSIVE {V.SIGHTINGS}, q AS (SELECT CAST(seq % 40 AS VARCHAR) AS key, seq, ms, seq % 3 = 0 AS fails, row_number() OVER (PARTITION BY seq % 40 ORDER BY t, seq) AS n FROM s),
    r(key, n, seq, last, failed, sent) AS (SELECT key, n, seq, ms, fails, true FROM q WHERE n = 1
      UNION ALL SELECT q.key, q.n, q.seq, CASE WHEN r.failed AND q.ms - r.last >= 259200000 THEN q.ms ELSE r.last END, CASE WHEN r.failed AND q.ms - r.last >= 259200000 THEN q.fails ELSE r.failed END, r.failed AND q.ms - r.last >= 259200000 FROM r JOIN q ON q.key = r.key AND q.n = r.n + 1)
    SELECT 'alt' AS kind, key, seq, failed AS fails FROM r WHERE sent""",
)
def _(spark, sf):
    from trailmark.streaming.state import memo

    s = V.sightings(spark, sf)
    return memo(s.select(F.lit("alt").alias("kind"), (F.col("seq") % 40).cast("string").alias("key"), "seq", "t", (F.col("seq") % 3 == 0).alias("fails")), 3 * 86400.0)


def samples(spark, sf):
    """Each sighting is a sample, 90 m after the one before; every third is a point of its track."""
    from pyspark.sql import Window

    from trailmark.operators.profile import numbered

    i = F.row_number().over(Window.partitionBy("track").orderBy("t", "seq")) - 1
    rows = V.sightings(spark, sf).select("track", i.alias("i"), "z", (F.col("seq") % 3 == 0).alias("point"))
    return numbered(rows.withColumn("d", F.col("i") * 90.0))


PROFILE_SQL = f"""WITH RECURSIVE {V.SIGHTINGS}, a AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY t, seq) - 1 AS i, z, seq % 3 = 0 AS point FROM s),
b AS (SELECT *, i * 90.0::DOUBLE AS d, CASE WHEN point THEN count(*) FILTER (point) OVER (PARTITION BY track ORDER BY i) - 1 ELSE -1 END AS k FROM a),
l AS (SELECT track, min(z) AS lo, max(z) AS hi, greatest(max(d), CASE WHEN max(d) = 0 THEN 1 ELSE 0 END) AS dmax FROM b GROUP BY 1 HAVING count(z) >= 2),
m AS (SELECT track, dmax, CASE WHEN hi - lo < 20 THEN (hi + lo) / 2 - 10 ELSE lo END AS lo, CASE WHEN hi - lo < 20 THEN (hi + lo) / 2 + 10 ELSE hi END AS hi FROM l),
p AS (SELECT *, (hi - lo) / 4 AS raw, pow(10, floor(log10(greatest((hi - lo) / 4, 1)))) AS p10 FROM m),
q AS (SELECT *, CASE WHEN p10 >= raw THEN p10 WHEN 2 * p10 >= raw THEN 2 * p10 WHEN 5 * p10 >= raw THEN 5 * p10 ELSE 10 * p10 END AS step FROM p),
c AS (SELECT track, dmax, step, floor(lo / step) * step AS y0, ceil(hi / step) * step AS y1 FROM q),
e AS (SELECT b.*, c.dmax, 60.0::DOUBLE + d / dmax * 514 AS px, 22.0::DOUBLE + (1 - (z - y0) / (y1 - y0)) * 152 AS py FROM b JOIN c USING (track) WHERE z IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i) AS o FROM e WHERE k >= 0),
f(track, o, k, z, px, py, seed, grp) AS (SELECT track, o, k, z, px, py, px, 0 FROM n WHERE o = 1
  UNION ALL SELECT n.track, n.o, n.k, n.z, n.px, n.py, CASE WHEN n.px - f.seed < 22 THEN f.seed ELSE n.px END, CASE WHEN n.px - f.seed < 22 THEN f.grp ELSE f.grp + 1 END FROM f JOIN n ON n.track = f.track AND n.o = f.o + 1),
g AS (SELECT track, grp, min(seed) AS px, arg_min(py, o) AS py, min(k) AS k0, max(k) AS k1, min(z) AS lo, max(z) AS hi FROM f GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN k0 = k1 THEN CAST(k0 + 1 AS VARCHAR) ELSE (k0 + 1) || '-' || (k1 + 1) END AS label FROM g),
j AS (SELECT *, greatest(18, 8 + length(label) * 8) AS w, replace(format('{{:,}}', CAST(floor(lo + 0.5::DOUBLE) AS BIGINT)), ',', chr(8239)) || CASE WHEN hi - lo >= 5 THEN '-' || replace(format('{{:,}}', CAST(floor(hi + 0.5::DOUBLE) AS BIGINT)), ',', chr(8239)) ELSE '' END AS text FROM h),
v AS (SELECT track, grp, floor(least(greatest(px, 60 + w / 2.0::DOUBLE - 9), 583 - w / 2.0::DOUBLE) * 10 + 0.5::DOUBLE) / 10 AS x, floor(py * 10 + 0.5::DOUBLE) / 10 AS y, label, text FROM j),
r(track, grp, x, y, label, text, here, shown) AS (SELECT track, -1, 0.0::DOUBLE, 0.0::DOUBLE, '', '', -99.0::DOUBLE, false FROM v WHERE grp = 0
  UNION ALL SELECT v.track, v.grp, v.x, v.y, v.label, v.text, CASE WHEN v.x - r.here >= 30 + length(v.text) * 4 THEN v.x ELSE r.here END, v.x - r.here >= 30 + length(v.text) * 4 FROM r JOIN v ON v.track = r.track AND v.grp = r.grp + 1),
t AS (SELECT track, step, y0, y1, unnest(generate_series(0, CAST(floor((y1 + 0.1::DOUBLE - y0) / step) AS BIGINT))) AS j FROM c)
SELECT track, 'tick' AS kind, CAST(j AS INTEGER) AS ord, 60.0::DOUBLE AS x, floor((22.0::DOUBLE + (1 - j * step / (y1 - y0)) * 152) * 10 + 0.5::DOUBLE) / 10 AS y, NULL::DOUBLE AS y2, replace(format('{{:,}}', CAST(y0 + j * step AS BIGINT)), ',', chr(8239)) AS label, NULL AS text, true AS shown FROM t
UNION ALL SELECT track, 'line', CAST(floor(px) AS INTEGER), floor(px), floor(min(py) * 10 + 0.5::DOUBLE) / 10, floor(max(py) * 10 + 0.5::DOUBLE) / 10, NULL, NULL, true FROM e GROUP BY track, floor(px)
UNION ALL SELECT track, 'end', 0, 60, 194, NULL, '0', NULL, true FROM c
UNION ALL SELECT track, 'end', 1, 574, 194, NULL, CASE WHEN dmax < 1000 THEN CAST(CAST(dmax AS BIGINT) AS VARCHAR) || ' m' WHEN dmax < 10000 THEN replace(format('{{:.2f}}', dmax / 1000), '.', ',') || ' km' ELSE replace(format('{{:.1f}}', dmax / 1000), '.', ',') || ' km' END, NULL, true FROM c
UNION ALL SELECT track, 'pin', CAST(grp AS INTEGER), x, y, NULL, label, text, shown FROM r WHERE grp >= 0"""


@query("profile_rows", PROFILE_SQL)
def _(spark, sf):
    from trailmark.operators.profile import profile_rows

    return profile_rows(samples(spark, sf))


# Small columns: link fragments, areas, signed degrees, editable dates, altitudes of points, doubles in a row.
@query(
    "fragment_texts",
    "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '45.' || CAST(event_id AS VARCHAR) || ',-6.5' WHEN 1 THEN '-12,' || CAST(event_id % 180 AS VARCHAR) || '.25' END AS text FROM events",
)
def _(spark, sf):
    from trailmark.sources.tracks import fragment_text

    e = F.col("event_id")
    n = e.cast("string")
    hashes = F.when(e % 4 == 0, F.concat(F.lit("#45."), n, F.lit(",-6.5"))).when(e % 4 == 1, F.concat(F.lit("-12%2C"), (e % 180).cast("string"), F.lit(".25"))).when(e % 4 == 2, F.concat(F.lit("#s=45.1,"), n)).otherwise(F.concat(F.lit("#45.1,+"), n, F.lit("%")))
    return V.read(spark, sf, "events").select(e.alias("id"), hashes.alias("hash")).select("id", fragment_text("hash").alias("text"))


@query("quad_areas", "SELECT event_id AS id, (event_id % 90) * (event_id % 70 + 1) / 2.0::DOUBLE + (event_id % 90) * (event_id % 70 + 1) / 2.0::DOUBLE AS area FROM events")
def _(spark, sf):
    from trailmark.functions.geo import quad_area

    w, h, o = (F.col("event_id") % 90).cast("double"), (F.col("event_id") % 70 + 1).cast("double"), F.lit(0.0)
    return V.read(spark, sf, "events").select(F.col("event_id").alias("id"), quad_area(F.array(o, w, w + 3, o + 3), F.array(o, o, h, h)).alias("area"))


@query("signed_degrees", "SELECT event_id AS id, CASE WHEN event_id % 200 > 100 THEN '+' ELSE '' END || CASE WHEN event_id % 200 < 100 THEN '-' ELSE '' END || CAST(abs(event_id % 200 - 100) // 10 AS VARCHAR) || ',' || CAST(abs(event_id % 200 - 100) % 10 AS VARCHAR) || '°' AS text FROM events")
def _(spark, sf):
    from trailmark.functions.text import signed_degrees

    return V.read(spark, sf, "events").select(F.col("event_id").alias("id"), signed_degrees((F.col("event_id") % 200 - 100) / 10.0).alias("text"))


@query("local_values", f"WITH {V.SIGHTINGS} SELECT seq AS id, strftime(t, '%Y-%m-%dT%H:%M') AS text FROM s")
def _(spark, sf):
    from trailmark.functions.text import local_value

    s = V.sightings(spark, sf)
    return s.select(F.col("seq").alias("id"), local_value("t").alias("text"))


@query("point_altitudes", f"WITH {V.SIGHTINGS} SELECT track, seq AS k, CASE WHEN seq % 5 <> 0 THEN z END AS z FROM s WHERE seq % 3 = 0")
def _(spark, sf):
    from trailmark.operators.track import point_altitudes

    q = F.col("seq")
    s = V.sightings(spark, sf).select("track", q.alias("i"), (q % 4).alias("j"), F.when(q % 3 == 0, q).otherwise(-1).alias("k"), "z")
    return point_altitudes(s.select("track", "i", "j", "k"), s.where("i % 5 <> 0").select("track", "i", "j", "z"))


@query(
    "track_doubles",
    f"""WITH {V.SIGHTINGS}, n AS (SELECT track, seq, ms + seq % 2 * 30000 AS ms, lat + seq % 3 * 0.00001::DOUBLE AS lat, lon FROM s), d AS (SELECT track, seq, ms, lat, lon FROM n UNION ALL SELECT track, seq + 10000000, ms + 40000, lat + 0.00001::DOUBLE, lon FROM n WHERE seq % 2 = 0),
    l AS (SELECT *, lead(seq) OVER w AS s2, lead(ms) OVER w AS ms2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM d WINDOW w AS (PARTITION BY track ORDER BY ms, seq))
    SELECT track, seq, s2 AS next FROM l WHERE s2 IS NOT NULL AND abs(ms2 - ms) < 60000 AND {V.hav("lat", "lon", "lat2", "lon2")} < 3""",
)
def _(spark, sf):
    from pyspark.sql import Window

    from trailmark.operators.track import is_dup

    q = F.col("seq")
    n = V.sightings(spark, sf).select("track", "seq", F.timestamp_millis(F.unix_millis("t") + q % 2 * 30000).alias("t"), (F.col("lat") + q % 3 * 0.00001).alias("lat"), "lon")
    more = n.where("seq % 2 = 0").select("track", (q + 10_000_000).alias("seq"), F.timestamp_millis(F.unix_millis("t") + 40000).alias("t"), (F.col("lat") + 0.00001).alias("lat"), "lon")
    w = Window.partitionBy("track").orderBy("t", "seq")
    point = F.struct("seq", "t", "lat", "lon")
    pairs = n.unionByName(more).select("track", point.alias("p"), F.lead(point).over(w).alias("q")).where("q is not null")
    return pairs.where(is_dup("p", "q")).select("track", F.col("p.seq").alias("seq"), F.col("q.seq").alias("next"))
