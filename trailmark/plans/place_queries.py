"""Queries of places, shots, stored sources and display tones, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import places as P, shots as H
from trailmark.plans import views as V
from trailmark.plans.reading_queries import PLACES, READINGS, readings

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def customers(spark, sf):
    return V.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


@query(
    "municipality_levels",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'city' WHEN c_custkey % 3 = 0 THEN 'town' WHEN c_custkey % 5 = 0 THEN 'village'
      WHEN c_custkey % 7 = 0 THEN 'municipality' WHEN c_custkey % 11 = 0 THEN 'hamlet' END AS name,
      CASE WHEN NOT (c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0) THEN NULL
      WHEN c_custkey % 4 = 1 THEN 'Suisse' ELSE '' END AS country FROM customer""",
)
def _(spark, sf):
    n = F.col("id")
    levels = {"city": 2, "town": 3, "village": 5, "municipality": 7, "hamlet": 11}
    pairs = [x for k, m in levels.items() for x in (F.lit(k), F.when(n % m == 0, k).otherwise(""))]
    address = F.create_map(*pairs, F.lit("country_code"), F.when(n % 4 == 1, "ch").otherwise("fr"), F.lit("country"), F.when(n % 4 == 1, "Suisse").otherwise("France"))
    return customers(spark, sf).select("id", P.municipality_of(address).alias("m")).select("id", "m.*")


@query(
    "altitude_sources",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN CAST(c_custkey % 3000 AS DOUBLE) WHEN c_custkey % 5 <> 0 THEN c_custkey % 2000 + 0.5::DOUBLE END AS z,
      CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 'model' WHEN c_custkey % 5 <> 0 THEN 'world' END AS z_source FROM customer""",
)
def _(spark, sf):
    from trailmark.functions.text import point_key

    n = F.col("id")
    points = customers(spark, sf).select("id", (n % 90).cast("double").alias("lat"), (n / 1000.0).alias("lon"))
    keyed = points.withColumn("key", point_key("lat", "lon"))
    model = keyed.where("id % 3 = 0").select("key", F.when(n % 4 == 0, -99999.0).otherwise((n % 3000).cast("double")).alias("z"))
    world = keyed.select("key", F.when(n % 5 == 0, float("nan")).otherwise(n % 2000 + 0.5).alias("z"))
    return P.altitude_of(points, model, world).select("id", "z", "z_source")


@query(
    "places_searched",
    """WITH e AS (SELECT p_partkey // 200 AS id, p_partkey AS eid, CASE WHEN p_partkey % 4 = 3 THEN 'way' ELSE 'node' END AS kind, p_partkey % 7 AS tag FROM part),
    w AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY eid) AS rank FROM e WHERE eid % 6 <> 0 AND ((kind = 'node' AND tag IN (0, 1, 2, 3)) OR (kind = 'way' AND tag IN (4, 5))))
    SELECT id, kind, eid FROM w WHERE rank <= CASE WHEN kind = 'node' THEN 80 ELSE 15 END""",
)
def _(spark, sf):
    k = F.col("p_partkey")
    key = F.element_at(F.array(*map(F.lit, ["natural", "mountain_pass", "tourism", "place", "natural", "natural", "shop"])), (k % 7 + 1).cast("int"))
    value = F.element_at(F.array(*map(F.lit, ["peak", "yes", "alpine_hut", "hamlet", "water", "glacier", "bakery"])), (k % 7 + 1).cast("int"))
    tags = F.map_filter(F.create_map(key, value, F.lit("name"), F.when(k % 6 != 0, "x")), lambda a, b: b.isNotNull())
    rows = V.read(spark, sf, "part").select(F.floor(k / 200).alias("id"), k.alias("eid"), F.when(k % 4 == 3, "way").otherwise("node").alias("kind"), tags.alias("tags"))
    return P.searched(rows).select("id", "kind", "eid")


@query(
    "place_lines",
    """SELECT c_custkey AS id, concat_ws(chr(10), CASE WHEN c_custkey % 2 = 0 THEN 'Commune : Bourg' || CASE c_custkey % 3 WHEN 0 THEN ' (73)' WHEN 1 THEN ' (Suisse)' ELSE '' END END,
      CASE WHEN c_custkey % 3 <> 0 THEN 'Altitude : ' || CAST(c_custkey % 900 AS VARCHAR) || ' m' END,
      CASE WHEN c_custkey % 5 <> 0 THEN 'Près de : Lac (lac, ' || CASE WHEN c_custkey % 100 < 50 THEN 'sur place' ELSE 'point à ' || CAST(c_custkey % 100 AS VARCHAR) || ' m au E' END || ')' END) AS text FROM customer""",
)
def _(spark, sf):
    n = F.col("id")
    points = customers(spark, sf)
    towns = points.where("id % 2 = 0").select("id", F.lit("Bourg").alias("name"), F.when(n % 3 == 0, "73").otherwise("").alias("department"), F.when(n % 3 == 1, "Suisse").otherwise("").alias("country"))
    heights = points.where("id % 3 <> 0").select("id", (n % 900).cast("double").alias("z"))
    near = points.where("id % 5 <> 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    near = near.select("id", "place", F.when(F.col("place") == 1, "Lac").otherwise("Col").alias("name"), F.lit("lac").alias("kind"), (n % 100).cast("double").alias("d"), F.lit(90.0).alias("b"))
    return P.place_lines(points, towns, heights, near)


SETTLED = f"""WITH {READINGS},
ref AS (SELECT q.photo, min(CASE WHEN q.i % 5 = 4 THEN 1000 + q.i ELSE q.i END) % 1000 AS i, min((q.i % 5 = 4)::INT) AS noted FROM q JOIN v USING (photo) WHERE q.off::INT = v.off GROUP BY 1),
t AS (SELECT v.photo, n1, n2, total, noted, ref.i, 44.0::DOUBLE + (v.photo * 7919 % 4000 + v.off * 17) / 1000.0::DOUBLE AS lat, 5.0::DOUBLE + (v.photo * 104729 % 4000) / 1000.0::DOUBLE AS lon,
  n1 >= 3 AND (n2 IS NULL OR n2 <= n1 - 2) AND total >= 3 AS sure, coalesce(n2 >= n1, false) AS rival FROM v JOIN ref USING (photo))"""

ORACLES["settle_reading"] = f"""{SETTLED}
SELECT photo, printf('%.6f, %.6f', lat, lon) AS text, false AS "none", sure, rival, lat, lon, 'DD' AS fmt,
  concat_ws(',', CASE WHEN noted = 1 THEN 'lat:short_minutes' END, CASE WHEN NOT sure THEN 'agreement' END) AS notes,
  CAST(least(n1, total) AS INTEGER) AS agree, CAST(total AS BIGINT) AS total, CAST(photo * 31 % 101 AS INTEGER) AS tess FROM t"""


@query(
    "read_photos",
    f"""{SETTLED}, c AS (SELECT *, noted + (NOT sure)::INT AS notes, CASE WHEN sure OR n2 IS NULL THEN 0 ELSE 1 END AS alts, least(n1, total) AS agree FROM t),
    b AS (SELECT *, CASE WHEN sure THEN 88 + least(7.0::DOUBLE, 2.0::DOUBLE * greatest(0, agree - 3)) ELSE 75.0::DOUBLE * agree / total END + greatest(-10, least(5, (photo * 31 % 101 - 60) / 4.0::DOUBLE)) AS base,
      CASE WHEN rival THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN notes > 0 THEN pow(0.85::DOUBLE, least(2, notes)) ELSE 1 END * CASE WHEN alts > 0 AND NOT rival THEN 0.8::DOUBLE ELSE 1 END AS f FROM c),
    p AS (SELECT *, CAST(greatest(0, least(100, floor(base * f + 0.5::DOUBLE))) AS INTEGER) AS pct FROM b)
    SELECT photo, lat, lon, pct, CASE WHEN notes = 0 AND alts = 0 AND sure AND NOT rival AND pct >= 70 THEN 'ok' ELSE 'check' END AS level,
      CASE WHEN notes = 0 AND alts = 0 AND sure AND NOT rival AND pct >= 70 THEN 'ok' ELSE 'check' END AS st FROM p""",
)
def _(spark, sf):
    return H.read_photos(readings(spark, sf))


@query(
    "reading_confidence",
    """WITH r AS (SELECT event_id AS photo, unnest(generate_series(0, event_id % 9 + 2)) AS i FROM events)
    SELECT photo, CAST(i AS INTEGER) AS pass_idx, CASE WHEN i % 4 <> 3 THEN ((photo + i) % 101 * 2 + (photo * 3 + i) % 101 * 6) / 8.0::DOUBLE END AS tess FROM r""",
)
def _(spark, sf):
    r = readings(spark, sf).select("photo", "pass_idx", "tess")
    p, i = F.col("photo"), F.col("pass_idx")
    word = lambda text, c: F.struct(F.lit(text).alias("text"), c.cast("double").alias("confidence"))
    heard = F.when(i % 4 != 3, F.array(word("N", F.lit(10)), word("45", (p + i) % 101), word("'", F.lit(5)), word("menu", F.lit(3)), word("16.277", (p * 3 + i) % 101)))
    words = r.select("photo", "pass_idx", F.explode_outer(F.coalesce(heard, F.array(word("menu", F.lit(50))))).alias("w")).select("photo", "pass_idx", "w.*")
    return H.reading_confidence(r, words)


@query(
    "shots_ended",
    """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'fail' WHEN 2 THEN 'wait' WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'none' END ELSE 'wait' END AS st FROM events""",
)
def _(spark, sf):
    e = V.read(spark, sf, "events").select(F.col("event_id").alias("id"))
    how = F.element_at(F.array(*map(F.lit, ["bad", "fail", "stop", "read"])), (F.col("id") % 5 + 1).cast("int"))
    last = e.where("id % 5 < 4").select("id", F.lit(2).alias("seq"), how.alias("how"))
    outcomes = last.unionByName(last.select("id", F.lit(1).alias("seq"), F.lit("fail").alias("how")))
    return H.ended(e, outcomes, e.where("id % 2 = 0").select(F.col("id").alias("photo"), F.lit("ok").alias("st")))


@query("shots_left", "SELECT event_id AS id FROM events WHERE event_id % 3 = 0 OR event_id % 4 IN (0, 1)")
def _(spark, sf):
    e = V.read(spark, sf, "events").select(F.col("event_id").alias("id"))
    st = F.element_at(F.array(*map(F.lit, ["wait", "fail", "ok", "check"])), (F.col("id") % 4 + 1).cast("int"))
    return H.left_to_read(e, e.where("id % 3 <> 0").select("id", st.alias("st")))


@query(
    "relief_cache",
    f"""WITH RECURSIVE {V.SIGHTINGS}, k AS (SELECT seq, ms, seq % 40 AS path, seq % 3 = 0 AS fails FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ms, seq) AS n FROM k),
    r(path, n, seq, ms, fails, asked) AS (SELECT path, n, seq, ms, fails, true FROM o WHERE n = 1
      UNION ALL SELECT o.path, o.n, CASE WHEN r.fails THEN o.seq ELSE r.seq END, o.ms, CASE WHEN r.fails THEN o.fails ELSE false END, r.fails FROM r JOIN o ON o.path = r.path AND o.n = r.n + 1)
    SELECT path, seq, fails FROM r WHERE asked""",
)
def _(spark, sf):
    from trailmark.streaming.state import memo

    s = V.sightings(spark, sf)
    path = F.col("seq") % 40
    lat, lon = F.array(path / 10.0, path / 10.0 + 1), F.array(path / 20.0, path / 20.0 + 1)
    asked = memo(s.select(F.lit("relief").alias("kind"), H.relief_key(lat, lon).alias("key"), "seq", "t", (F.col("seq") % 3 == 0).alias("fails")), 0.0)
    return asked.select((F.col("seq") % 40).alias("path"), "seq", "fails")


@query("display_tone", "SELECT event_id AS id, CAST(floor(255 / (1 + exp(-(event_id % 256 - 128) / 30.0::DOUBLE)) + 0.5::DOUBLE) AS INTEGER) AS tone FROM events")
def _(spark, sf):
    import numpy as np

    from trailmark.functions.image import display_tone

    levels = F.array(*[F.lit(int(x)) for x in display_tone(np.arange(256))])
    return V.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.element_at(levels, (F.col("event_id") % 256 + 1).cast("int")).alias("tone"))


@query("service_answers", "SELECT event_id AS key, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN CAST(event_id % 900 AS DOUBLE) END AS z, event_id % 3 = 0 OR event_id % 5 = 0 AS failed FROM events")
def _(spark, sf):
    from trailmark.sources.stored import answers

    e = F.col("event_id")
    body = F.when(e % 5 == 0, "<html>").otherwise(F.format_string('{"z": %d}', e % 900))
    rows = V.read(spark, sf, "events").select(e.alias("key"), F.when(e % 3 == 0, 503).otherwise(200).alias("status"), body.alias("body"))
    return answers(rows, "z double").select("key", "value.z", "failed")


@query(
    "stored_names",
    """WITH n AS (SELECT user_id AS track, ts AS t, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE ' tour ' || CAST(event_id AS VARCHAR) || ' ' END AS name FROM events)
    SELECT track, nullif(trim(arg_max(name, (t, seq))), '') AS name FROM n GROUP BY 1""",
)
def _(spark, sf):
    from trailmark.sources.stored import track_names

    s = V.sightings(spark, sf)
    name = F.when(F.col("seq") % 3 == 0, " ").otherwise(F.concat(F.lit(" tour "), F.col("seq").cast("string"), F.lit(" ")))
    return track_names(s.select("track", "t", "seq", name.alias("name")))


@query(
    "stored_history",
    """WITH e AS (SELECT user_id AS owner, event_id % 50 AS k, event_id AS seq, ts AS t FROM events WHERE event_id % 4 <> 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY owner, k ORDER BY t DESC, seq DESC) AS n FROM e), p AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY t DESC, seq DESC) AS place FROM u WHERE n = 1)
    SELECT owner, CAST(place AS INTEGER) AS place, k, CASE WHEN seq % 7 = 0 THEN '' ELSE 'text ' || CAST(seq AS VARCHAR) END AS src FROM p WHERE place <= 10""",
)
def _(spark, sf):
    from trailmark.sources.stored import stored_history

    s = V.sightings(spark, sf)
    src = F.when(F.col("seq") % 7 == 0, "").when(F.col("seq") % 4 != 0, F.concat(F.lit("text "), F.col("seq").cast("string")))
    rows = s.select(F.col("track").alias("owner"), F.when(F.col("seq") % 4 != 0, F.col("seq") % 50).alias("k"), src.alias("src"), "t", "seq")
    return stored_history(rows).select("owner", "place", "k", "src")


@query(
    "places_search_near",
    f"""WITH {PLACES}, t AS (SELECT b.*, p_partkey % 7 AS tag FROM b JOIN part ON p_partkey = pid), j AS (SELECT s.seq AS id, pid, name, kind, tag, {V.hav("s.lat", "s.lon", "t.lat", "t.lon")} AS d, m FROM s JOIN t ON tag <> 5 AND abs(s.lat - t.lat) < 0.02 WHERE {V.hav("s.lat", "s.lon", "t.lat", "t.lon")} <= 2000),
n AS (SELECT id, pid, tag IN (3, 4) AS way, any_value(name) AS name, any_value(kind) AS kind, min(d) AS d FROM j GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY pid) AS rank FROM n),
u AS (SELECT *, row_number() OVER (PARTITION BY id, lower(name) ORDER BY d, pid) AS r FROM l WHERE rank <= CASE WHEN way THEN 1 ELSE 2 END AND kind IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, pid) AS place FROM u WHERE r = 1)
SELECT id, place, name, kind, round(d, 3) AS d FROM k WHERE place <= 3""",
)
def _(spark, sf):
    from trailmark.plans.reading_queries import places

    points = V.sightings(spark, sf).select(F.col("seq").alias("id"), "lat", "lon")
    elements = places(spark, sf).select(F.col("pid").alias("eid"), F.when((F.col("pid") % 7).isin(3, 4), "way").otherwise("node").alias("element"), "tags", "geometry")
    return P.search_near(points, elements, nodes=2, ways=1).select("id", F.col("place").cast("long").alias("place"), "name", "kind", F.round("d", 3).alias("d"))


# SQL forms of queries that stand in other modules
ORACLES["doubt_carry"] = """WITH e AS (SELECT user_id AS chain, event_id AS seq, event_id % 7 <> 0 AS ok, event_id % 5 = 0 AS ocr, event_id % 11 = 0 AS verified, CAST(event_id % 100 AS INTEGER) AS pct,
  CASE WHEN event_id % 3 = 0 THEN 'check' ELSE 'ok' END AS level FROM events),
o AS (SELECT *, ocr OR verified OR NOT ok OR row_number() OVER (PARTITION BY chain ORDER BY seq) = 1 AS own FROM e),
g AS (SELECT *, max(CASE WHEN own THEN seq END) OVER (PARTITION BY chain ORDER BY seq) AS src FROM o),
d AS (SELECT g.*, NOT g.own AND s.ocr AND s.ok AND NOT (s.verified OR s.level = 'ok') AS doubtful, s.pct AS first_pct FROM g JOIN e s ON s.seq = g.src)
SELECT chain, seq, ok, ocr OR doubtful AS ocr, CASE WHEN doubtful THEN first_pct ELSE pct END AS pct, CASE WHEN doubtful THEN 'check' ELSE level END AS level FROM d"""

ORACLES["box_widen"] = """WITH b AS (SELECT n_nationkey AS id, n_nationkey / 50.0::DOUBLE AS x, n_nationkey / 60.0::DOUBLE AS y, 0.2::DOUBLE AS w, 0.1::DOUBLE AS h FROM nation),
c AS (SELECT id, greatest(0.0::DOUBLE, x - w * 0.15::DOUBLE) AS x, greatest(0.0::DOUBLE, y - h) AS y, least(1.0::DOUBLE, x + w * 1.15::DOUBLE) AS x1, least(1.0::DOUBLE, y + h * 2) AS y1 FROM b)
SELECT id, x, y, x1 - x AS w, y1 - y AS h FROM c"""

ORACLES["box_turn"] = """WITH n AS (SELECT n_nationkey AS id, radians(n_nationkey * 3.0::DOUBLE) AS a, n_nationkey / 50.0::DOUBLE AS x, n_nationkey / 60.0::DOUBLE AS y FROM nation),
t AS (SELECT *, 640 * abs(cos(a)) + 480 * abs(sin(a)) AS tw, 640 * abs(sin(a)) + 480 * abs(cos(a)) AS th, (x + 0.1::DOUBLE - 0.5::DOUBLE) * 640 AS dx, (y + 0.05::DOUBLE - 0.5::DOUBLE) * 480 AS dy FROM n),
s AS (SELECT *, least(1, 128 / tw) AS w, least(1, 48 / th) AS h FROM t),
p AS (SELECT *, (dx * cos(a) - dy * sin(a)) / tw + 0.5::DOUBLE - w / 2 AS px, (dx * sin(a) + dy * cos(a)) / th + 0.5::DOUBLE - h / 2 AS py FROM s)
SELECT id, round(greatest(0, least(1 - w, px)), 9) AS x, round(greatest(0, least(1 - h, py)), 9) AS y, round(w, 9) AS w, round(h, 9) AS h FROM p"""

ORACLES["resume_texts"] = """SELECT user_id AS track, CAST(count(*) AS VARCHAR) || ' point' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ', ' || strftime(max(ts), '%d/%m %H:%M') AS text FROM events GROUP BY 1"""

ORACLES["stream_relief_throttle"] = f"""WITH RECURSIVE {V.SIGHTINGS}, o AS (SELECT track, seq, 45.0::DOUBLE + (seq * 37 % 11) * 0.0001::DOUBLE AS lat, row_number() OVER (PARTITION BY track ORDER BY t, seq) AS n FROM s),
r(track, n, seq, lat, last, kept) AS (SELECT track, n, seq, lat, lat, true FROM o WHERE n = 1
  UNION ALL SELECT o.track, o.n, o.seq, o.lat, CASE WHEN {V.hav("r.last", "6.0::DOUBLE", "o.lat", "6.0::DOUBLE")} > 25 THEN o.lat ELSE r.last END, {V.hav("r.last", "6.0::DOUBLE", "o.lat", "6.0::DOUBLE")} > 25 FROM r JOIN o ON o.track = r.track AND o.n = r.n + 1)
SELECT track AS device, seq, lat, 6.0::DOUBLE AS lon FROM r WHERE kept"""

ORACLES["stream_announcements"] = f"""WITH RECURSIVE {V.SIGHTINGS}, o AS (SELECT track, seq, ms, row_number() OVER (PARTITION BY track ORDER BY ms, seq) AS n FROM s),
r(track, n, seq, last, kept) AS (SELECT track, n, seq, ms, true FROM o WHERE n = 1
  UNION ALL SELECT o.track, o.n, o.seq, CASE WHEN o.ms - r.last >= 86400000 THEN o.ms ELSE r.last END, o.ms - r.last >= 86400000 FROM r JOIN o ON o.track = r.track AND o.n = r.n + 1)
SELECT track AS device, seq FROM r WHERE kept"""

ORACLES["service_memo"] = f"""WITH RECURSIVE {V.SIGHTINGS}, o AS (SELECT seq % 40 AS k, seq, ms, seq % 3 = 0 AS fails, row_number() OVER (PARTITION BY seq % 40 ORDER BY ms, seq) AS n FROM s),
r(k, n, seq, last, failed, kept) AS (SELECT k, n, seq, ms, fails, true FROM o WHERE n = 1
  UNION ALL SELECT o.k, o.n, o.seq, CASE WHEN r.failed AND o.ms - r.last >= 259200000 THEN o.ms ELSE r.last END, CASE WHEN r.failed AND o.ms - r.last >= 259200000 THEN o.fails ELSE r.failed END,
    r.failed AND o.ms - r.last >= 259200000 FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1)
SELECT 'alt' AS kind, CAST(k AS VARCHAR) AS key, seq, seq % 3 = 0 AS fails FROM r WHERE kept"""

ORACLES["read_loop"] = f"""WITH {READINGS},
f AS (SELECT q.photo, u.i AS upto, q.off, count(*) AS n, sum(q.w) AS w, min(q.i) AS first FROM q JOIN q u ON u.photo = q.photo AND q.i <= u.i AND u.i < 11 GROUP BY 1, 2, 3),
h AS (SELECT *, row_number() OVER (PARTITION BY photo, upto ORDER BY w DESC, first) AS place FROM f),
x AS (SELECT photo, upto, max(n) FILTER (place = 1) AS n1, max(n) FILTER (place = 2) AS n2 FROM h GROUP BY 1, 2),
z AS (SELECT photo, coalesce(min(upto) FILTER (n1 >= 3 AND (n2 IS NULL OR n2 <= n1 - 2)), max(upto)) AS stop FROM x GROUP BY 1)
SELECT photo, stop + 1 AS passes, CAST(stop AS INTEGER) AS last FROM z"""

ORACLES["read_two_step"] = """WITH r AS (SELECT event_id AS photo, unnest(generate_series(0, event_id % 9 + 2)) AS i FROM events),
q AS (SELECT 'found' AS box, * FROM r WHERE photo % 3 <> 0 OR i < 2 UNION ALL SELECT 'wide', * FROM r WHERE i < 6),
g AS (SELECT box, photo, (photo + i) % 4 = 0 AS off, count(*) AS n, sum(CASE WHEN i % 5 = 4 THEN 6 ELSE 10 END) AS w, min(i) AS first FROM q GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY box, photo ORDER BY w DESC, first) AS place FROM g),
v AS (SELECT box, photo, max(n) FILTER (place = 1) AS n1, max(n) FILTER (place = 2) AS n2, max(off::INT) FILTER (place = 1) AS off FROM o GROUP BY 1, 2),
s AS (SELECT *, n1 >= 3 AND (n2 IS NULL OR n2 <= n1 - 2) AS sure FROM v),
p AS (SELECT a.photo, CASE WHEN NOT a.sure AND b.sure THEN 'wide' ELSE 'found' END AS box FROM s a JOIN s b ON a.photo = b.photo AND a.box = 'found' AND b.box = 'wide')
SELECT photo, box, sure, 44.0::DOUBLE + (photo * 7919 % 4000 + off * 17) / 1000.0::DOUBLE AS lat, 5.0::DOUBLE + (photo * 104729 % 4000) / 1000.0::DOUBLE AS lon, CAST(n1 AS INTEGER) AS agree FROM s JOIN p USING (photo, box)"""
