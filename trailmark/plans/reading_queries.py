"""Queries of the parser, votes, trust and spatial operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import parse as P, parse_columns as N, parse_shapes as H, spatial as S, trust as U, vote as O
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


def parsed(spark, sf):
    return N.parse_once(V.texts(spark, sf), parser=N.parse_strict)


@query("parse_position", f"WITH {V.TEXTS} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, fmt, true AS ok FROM e")
def _(spark, sf):
    return parsed(spark, sf).select("id", F.round("p.best.lat", 6).alias("lat"), F.round("p.best.lon", 6).alias("lon"), F.col("p.best.fmt").alias("fmt"), F.col("p.ok").alias("ok"))


@query("parse_reliability", f"WITH {V.TEXTS} SELECT id, shape, conf FROM e")
def _(spark, sf):
    return parsed(spark, sf).select("id", "shape", F.col("p.conf").alias("conf"))


@query("parse_alternatives")
def _(spark, sf):
    e = V.texts(spark, sf)
    two = e.select("id", F.concat("text", F.lit(" or "), F.lead("text", 1, "N 45°16.277' E 005°56.052'").over(__import__("pyspark").sql.Window.partitionBy(F.col("id") % 64).orderBy("id"))).alias("text"))
    return H.all_positions(two).select("id", "rank", "lat", "lon", "fmt", "score", "seg")


UTM_SQL = f"WITH {V.WORLD} SELECT id, true AS near, true AS same_zone FROM w"


@query("parse_utm", UTM_SQL)
def _(spark, sf):
    from trailmark.functions.geo import haversine_m, utm_zone
    from trailmark.functions.text import utm_text

    w = V.world(spark, sf).withColumn("zone", utm_zone("lon"))
    parts = F.split(utm_text("lat", "lon"), " ")
    text = F.concat_ws(" ", parts[0], F.lpad(parts[1], 7, "0"), F.lpad(parts[2], 7, "0"))
    p = N.parse_positions(w.withColumn("text", text))
    return p.select("id", (haversine_m("lat", "lon", "p.best.lat", "p.best.lon") < 2).alias("near"), F.startswith(F.col("p.best.fmt"), F.concat(F.lit("UTM "), F.col("zone").cast("string"))).alias("same_zone"))


@query("text_normalize", "SELECT event_id AS id, CAST(event_id % 90 AS VARCHAR) || ' ° ' || CAST(event_id % 60 AS VARCHAR) || '.' || CAST(event_id % 1000 AS VARCHAR) || '15 \" 005' AS norm FROM events")
def _(spark, sf):
    e = F.col("event_id")
    raw = F.concat((e % 90).cast("string"), F.lit(" deg "), (e % 60).cast("string"), F.lit("."), (e % 1000).cast("string"), F.lit("l5 '' OO5"))
    return V.read(spark, sf, "events").select(e.alias("id"), N.normalise(raw).alias("norm"))


@query("text_tokens")
def _(spark, sf):
    return V.texts(spark, sf).select("id", F.posexplode(N.token_rows("text")).alias("at", "t")).select("id", "at", "t.kind", "t.start", "t.end", "t.text", "t.symbol")


@query(
    "text_runs",
    "WITH x AS (SELECT event_id AS id, event_id % 8 AS shape FROM events) SELECT id, CASE WHEN shape = 4 THEN 6 ELSE 0 END AS run, CASE WHEN shape IN (0, 1) THEN 4 WHEN shape = 5 THEN 6 ELSE 2 END AS numbers, CASE WHEN shape IN (0, 5, 7) THEN 2 ELSE 0 END AS hemispheres FROM x",
)
def _(spark, sf):
    t = V.texts(spark, sf).select("id", F.explode(N.token_rows("text")).alias("t")).where("t.kind <> 'word'")
    return t.groupBy("id", "t.run").agg(F.count_if(F.col("t.kind") == "num").alias("numbers"), F.count_if(F.col("t.kind") == "hemi").alias("hemispheres"))


# readings of a photo: three to eleven copies of a position, some moved by a minute; spacing far above the tolerance
def readings(spark, sf):
    e = V.read(spark, sf, "events").select(F.col("event_id").alias("photo"))
    rows = e.select("photo", F.explode(F.sequence(F.lit(0), (F.col("photo") % 9 + 2).cast("int"))).alias("pass_idx"))
    off = F.when((F.col("photo") + F.col("pass_idx")) % 4 == 0, 1).otherwise(0)
    lat, lon = F.lit(44.0) + (F.col("photo") * 7919 % 4000 + off * 17) / 1000.0, F.lit(5.0) + (F.col("photo") * 104729 % 4000) / 1000.0
    notes = F.when(F.col("pass_idx") % 5 == 4, F.array(F.lit("lat:short_minutes"))).otherwise(F.array().cast("array<string>"))
    alts = F.array().cast("array<struct<lat:double,lon:double>>")
    return rows.select("photo", "pass_idx", F.format_string("%.6f, %.6f", lat, lon).alias("txt"), F.lit(True).alias("ok"), lat.alias("lat"), lon.alias("lon"), F.lit("DD").alias("fmt"), notes.alias("notes"), alts.alias("alts"), (F.col("photo") * 31 % 101).cast("double").alias("tess"))


READINGS = """r AS (SELECT event_id AS photo, unnest(generate_series(0, event_id % 9 + 2)) AS i FROM events),
q AS (SELECT photo, i, (photo + i) % 4 = 0 AS off, CASE WHEN i % 5 = 4 THEN 6 ELSE 10 END AS w FROM r),
g AS (SELECT photo, off, count(*) AS n, sum(w) AS w, min(i) AS first FROM q GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY w DESC, first) AS place FROM g),
v AS (SELECT photo, max(CASE WHEN place = 1 THEN n END) AS n1, max(CASE WHEN place = 2 THEN n END) AS n2, max(CASE WHEN place = 1 THEN off::INT END) AS off, max(CASE WHEN place = 1 THEN w END) AS w1, sum(n) AS total FROM o GROUP BY 1)"""


@query("vote_axis", f"WITH {READINGS} SELECT photo, round(44.0::DOUBLE + (photo * 7919 % 4000 + off * 17) / 1000.0::DOUBLE, 6) AS lat, CAST(n1 AS INTEGER) AS n, round(w1 / 10.0::DOUBLE, 6) AS w, CAST(n2 AS INTEGER) AS second_n, CAST(total AS BIGINT) AS total, CAST(total AS INTEGER) AS lon_n FROM v")
def _(spark, sf):
    v = O.axis_votes(readings(spark, sf))
    return v.select("photo", F.round("lat_best.v", 6).alias("lat"), F.col("lat_best.n").alias("n"), F.round("lat_best.w", 6).alias("w"), F.col("lat_second.n").alias("second_n"), "total", F.col("lon_best.n").alias("lon_n"))


@query("vote_firm", f"WITH {READINGS} SELECT photo, n1 >= 3 AND (n2 IS NULL OR n2 <= n1 - 2) AND total >= 3 AS sure, coalesce(n2 >= n1, false) AS rival FROM v")
def _(spark, sf):
    return O.with_firm(O.axis_votes(readings(spark, sf))).select("photo", "sure", "rival")


@query("settle_reading")
def _(spark, sf):
    return O.settle(readings(spark, sf)).drop("alts").withColumn("notes", F.array_join("notes", ","))


@query("read_loop")
def _(spark, sf):
    kept = O.read_loop(readings(spark, sf).drop("txt", "fmt", "alts", "tess"))
    return kept.groupBy("photo").agg(F.count(F.lit(1)).alias("passes"), F.max("pass_idx").alias("last"))


@query("read_two_step")
def _(spark, sf):
    r = readings(spark, sf)
    narrow, wide = r.where("photo % 3 <> 0 or pass_idx < 2"), r.where("pass_idx < 6")
    return O.two_step(O.settle(narrow), O.settle(wide)).select("photo", "box", "sure", "lat", "lon", "agree")


def words(spark, sf):
    d = V.read(spark, sf, "documents").where("text is not null")
    w = d.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    pos = F.col("pos").cast("long")
    return w.select("doc_id", pos.alias("pos"), "text", ((F.col("doc_id") * 31 + pos * 17) % 101).cast("double").alias("confidence"), (pos % 40 * 10).alias("x0"), (F.floor(pos / 40) * 12).alias("y0"), (pos % 40 * 10 + 8).alias("x1"), (F.floor(pos / 40) * 12 + 10).alias("y1"))


WORDS = r"""d AS (SELECT doc_id, unnest(string_split(text, ' ')) AS text, unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS pos FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, (doc_id * 31 + pos * 17) % 101 AS confidence, greatest(1, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))) AS w, regexp_matches(text, '[0-9]|^[nsewoNSEWO]$|[°''"]') AS used FROM d)"""


@query("words_confidence", f"WITH {WORDS} SELECT doc_id, CAST(floor(sum(CASE WHEN used THEN confidence * w END) / CAST(sum(CASE WHEN used THEN w END) AS DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS confidence FROM c GROUP BY 1")
def _(spark, sf):
    return O.words_confidence(words(spark, sf), "doc_id")


@query("bbox_union", f"WITH {WORDS} SELECT doc_id, min(pos % 40 * 10) AS x0, min(pos // 40 * 12) AS y0, max(pos % 40 * 10 + 8) AS x1, max(pos // 40 * 12 + 10) AS y1 FROM c GROUP BY 1")
def _(spark, sf):
    return O.bounding_boxes(words(spark, sf), "doc_id")


def pages_of_lines(spark, sf):
    t = V.texts(spark, sf)
    line = (F.col("id") % 6).cast("int")
    text = F.when(line == 3, F.col("text")).otherwise(F.concat(F.lit("menu item "), F.col("shape").cast("string")))
    return t.select(F.floor(F.col("id") / 6).alias("page"), line.alias("line"), text.alias("text"), F.lit(0).alias("x0"), (line * 20).alias("y0"))


_MINUTES = "lpad(CAST({m} // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST({m} % 1000 AS VARCHAR), 3, '0')"
_SECONDS = "lpad(CAST({m} // 1000 AS VARCHAR), 2, '0') || chr(39) || lpad(CAST({m} % 1000 * 6 // 100 AS VARCHAR), 2, '0') || '.' || CAST({m} % 10 AS VARCHAR) || chr(34)"


@query(
    "zone_best_window",
    f"""WITH {V.TEXTS} SELECT id // 6 AS page, 3 AS i, 1 AS k, CASE x.shape WHEN 1 THEN CAST(dlat AS VARCHAR) || '° ' || {_MINUTES.format(m="mlat")} || chr(39) || ' ' || lpad(CAST(dlon AS VARCHAR), 3, '0') || '° ' || {_MINUTES.format(m="mlon")} || chr(39)
      WHEN 3 THEN 'GPS: ' || CAST(dlat AS VARCHAR) || '.' || lpad(CAST(mlat AS VARCHAR), 5, '0') || ', ' || CAST(dlon AS VARCHAR) || '.' || lpad(CAST(mlon AS VARCHAR), 5, '0')
      WHEN 5 THEN CAST(dlat AS VARCHAR) || '°' || {_SECONDS.format(m="mlat")} || 'N ' || lpad(CAST(dlon AS VARCHAR), 3, '0') || '°' || {_SECONDS.format(m="mlon")} || 'E'
      ELSE 'N ' || CAST(dlat AS VARCHAR) || {_MINUTES.format(m="mlat")} || ' E ' || lpad(CAST(dlon AS VARCHAR), 3, '0') || {_MINUTES.format(m="mlon")} END AS text,
    CASE x.shape WHEN 1 THEN 8.0::DOUBLE WHEN 3 THEN 5.0::DOUBLE WHEN 5 THEN 11.0::DOUBLE ELSE 5.0::DOUBLE END AS score, round(lat, 6) AS lat, round(lon, 6) AS lon FROM x JOIN e USING (id) WHERE id % 6 = 3""",
)
def _(spark, sf):
    z = O.best_zone(pages_of_lines(spark, sf))
    return z.select("page", "i", "k", "text", "score", F.round("p.best.lat", 6).alias("lat"), F.round("p.best.lon", 6).alias("lon"))


@query("zone_best_view", "SELECT DISTINCT event_id // 4 AS photo, '0' AS view, true AS clean, CASE WHEN event_id // 4 % 2 = 0 THEN 11.0::DOUBLE ELSE 5.0::DOUBLE END AS rank FROM events")
def _(spark, sf):
    p = P.parse_positions(V.texts(spark, sf)).select(F.floor(F.col("id") / 4).alias("photo"), (F.col("id") % 4).cast("int").alias("ord"), (F.col("id") % 4).cast("string").alias("view"), "p").where("p.ok")
    return O.best_view(p).select("photo", "view", "clean", "rank")


TRUST = """WITH i AS (SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN event_id % 101 END AS tess, CASE WHEN event_id % 11 <> 0 THEN event_id % 8 END AS n, event_id % 8 + event_id % 4 AS total, event_id % 2 = 0 AS firm, event_id % 5 = 0 AS rival, event_id % 4 AS notes, event_id // 7 % 2 AS alts, event_id % 13 = 0 AS manual FROM events),
b AS (SELECT *, manual OR n IS NULL AS plain, CASE WHEN firm THEN 88 + least(7.0::DOUBLE, 2.0::DOUBLE * greatest(0, n - 3)) WHEN total > 0 THEN 75.0::DOUBLE * n / total ELSE 0 END + CASE WHEN tess IS NOT NULL THEN greatest(-10, least(5, (tess - 60) / 4.0::DOUBLE)) ELSE 0 END AS base,
  CASE WHEN rival THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN notes > 0 THEN pow(0.85::DOUBLE, least(2, notes)) ELSE 1 END * CASE WHEN alts > 0 AND NOT rival THEN 0.8::DOUBLE ELSE 1 END AS f FROM i),
p AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN plain THEN 100 - 20 * notes - 15 * alts ELSE floor(base * f + 0.5::DOUBLE) END)) AS INTEGER) AS pct FROM b),
l AS (SELECT *, CASE WHEN notes = 0 AND alts = 0 AND (plain OR (firm AND NOT rival)) AND pct >= 70 THEN 'ok' ELSE 'check' END AS level FROM p)"""


def trust_rows(spark, sf):
    e = F.col("event_id")
    rows = V.read(spark, sf, "events").select(e.alias("id"), F.when(e % 3 != 0, e % 101).alias("tess"), F.when(e % 11 != 0, e % 8).alias("n"), (e % 8 + e % 4).alias("total"), (e % 2 == 0).alias("firm"), (e % 5 == 0).alias("rival"), (e % 4).alias("notes"), (F.floor(e / 7) % 2).alias("alts"), (e % 13 == 0).alias("manual"))
    return rows.withColumn("t", U.confidence(*[F.col(c) for c in ("tess", "n", "total", "firm", "rival", "notes", "alts", "manual")]))


@query("trust_score", f"{TRUST} SELECT id, pct, level FROM l")
def _(spark, sf):
    return trust_rows(spark, sf).select("id", "t.pct", "t.level")


@query("trust_gate", f"{TRUST} SELECT id, id % 6 <> 0 AND (id % 9 = 0 OR level = 'ok') AS trusted FROM l")
def _(spark, sf):
    return trust_rows(spark, sf).select("id", U.trusted(F.col("id") % 6 != 0, F.col("id") % 9 == 0, F.col("t.level")).alias("trusted"))


@query("doubt_carry")
def _(spark, sf):
    e = F.col("event_id")
    rows = V.read(spark, sf, "events").select(F.col("user_id").alias("chain"), e.alias("seq"), (e % 7 != 0).alias("ok"), (e % 5 == 0).alias("ocr"), (e % 11 == 0).alias("verified"), (e % 100).cast("int").alias("pct"), F.when(e % 3 == 0, "check").otherwise("ok").alias("level"))
    return U.carry_doubt(rows)


SHOTS = """WITH s AS (SELECT event_id AS id, user_id AS batch, event_id % 7 <> 0 AS found, event_id % 5 <> 0 AS has, CASE WHEN event_id % 3 = 0 THEN 'check' ELSE 'ok' END AS level, ts FROM events), t AS (SELECT *, CASE WHEN NOT found OR NOT has THEN 'none' ELSE level END AS st FROM s)"""


def shots(spark, sf):
    e = F.col("event_id")
    rows = V.read(spark, sf, "events").select(e.alias("id"), F.col("user_id").alias("batch"), V.instant("ts").alias("t"), U.shot_state(e % 7 != 0, e % 5 != 0, F.when(e % 3 == 0, "check").otherwise("ok"), (e % 100).cast("int"), e % 2 == 0, e % 4).alias("s"))
    return rows.select("id", "batch", "t", "s.*")


@query("shot_state", f"{SHOTS} SELECT id, st, CASE WHEN st <> 'none' THEN CAST(id % 100 AS INTEGER) END AS pct FROM t")
def _(spark, sf):
    return shots(spark, sf).select("id", "st", "pct")


@query("shot_point", "SELECT event_id AS id, CASE WHEN event_id % 6 = 0 THEN -1 ELSE event_id % 10 + least(event_id % 4, 2) END AS v FROM events")
def _(spark, sf):
    e = F.col("event_id")
    fix = F.when(e % 6 == 0, F.lit(-1).cast("long"))
    return V.read(spark, sf, "events").select(e.alias("id"), U.shot_point(fix, e % 10, F.array(e % 10 + 1, e % 10 + 2), (e % 4).cast("int")).alias("v"))


@query("batch_summary", f"{SHOTS} SELECT batch, count(*) FILTER (st = 'ok') AS ok, count(*) FILTER (st = 'check') AS to_check, count(*) FILTER (st = 'none') AS left_over, CAST(0 AS BIGINT) AS to_read, arg_max(CASE WHEN st = 'ok' THEN id END, (ts, id)) FILTER (st = 'ok') AS latest_ok FROM t GROUP BY 1")
def _(spark, sf):
    return U.batch_summary(shots(spark, sf))


@query("shot_latest_fix", "SELECT event_id AS id, CASE WHEN event_id % 4 <> 0 THEN 'none' WHEN event_id % 8 = 0 THEN 'check' ELSE 'ok' END AS st, CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 0 THEN 45.5::DOUBLE ELSE 44.0::DOUBLE END AS lat FROM events")
def _(spark, sf):
    e = V.read(spark, sf, "events").select(F.col("event_id").alias("id"))
    s = e.select("id", F.lit("none").alias("st"), F.lit(44.0).alias("lat"), F.lit(5.0).alias("lon"))
    fixed = e.where("id % 4 = 0")
    fixes = fixed.select("id", F.lit(1).alias("seq"), F.lit(False).alias("undo"), F.lit(45.5).alias("lat"), F.lit(5.5).alias("lon")).unionByName(fixed.where("id % 8 = 0").select("id", F.lit(2).alias("seq"), F.lit(True).alias("undo"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")))
    return U.latest_fix(s, fixes).select("id", "st", "lat")


# places: named points on a coarse grid, some names twice, some kinds excluded
KINDS = ["peak", "saddle", "spring", "water", "glacier", "bench", "cave_entrance"]


def places(spark, sf):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 7 + 1).cast("int"))
    tags = F.map_filter(F.create_map(F.lit("natural"), kind, F.lit("name"), F.concat(F.when(k % 2 == 0, "Name ").otherwise("NAME "), F.floor(k / 4).cast("string")), F.lit("water"), F.when(k % 3 == 0, "river").otherwise("pond")), lambda a, b: b.isNotNull())
    at = lambda m: F.struct((F.lit(44.0) + (k * 7919 % 4000 + m) / 1000.0).alias("lat"), (F.lit(5.0) + (k * 104729 % 4000) / 1000.0).alias("lon"))
    return V.read(spark, sf, "part").select(k.alias("pid"), tags.alias("tags"), F.array(at(0), at(9)).alias("geometry"))


PLACES = f"""{V.SIGHTINGS}, a AS (SELECT p_partkey AS pid, ['peak','saddle','spring','water','glacier','bench','cave_entrance'][p_partkey % 7 + 1] AS tag, (CASE WHEN p_partkey % 2 = 0 THEN 'Name ' ELSE 'NAME ' END) || CAST(p_partkey // 4 AS VARCHAR) AS name, unnest([0, 9]) AS m FROM part),
b AS (SELECT pid, name, CASE tag WHEN 'peak' THEN 'sommet' WHEN 'saddle' THEN 'col' WHEN 'spring' THEN 'source' WHEN 'water' THEN CASE WHEN pid % 3 = 0 THEN NULL ELSE 'lac' END WHEN 'glacier' THEN 'glacier' WHEN 'cave_entrance' THEN 'grotte' END AS kind,
  44.0::DOUBLE + (pid * 7919 % 4000 + m) / 1000.0::DOUBLE AS lat, 5.0::DOUBLE + (pid * 104729 % 4000) / 1000.0::DOUBLE AS lon, m FROM a)"""


@query("places_kind", "SELECT p_partkey AS pid, CASE p_partkey % 7 WHEN 0 THEN 'sommet' WHEN 1 THEN 'col' WHEN 2 THEN 'source' WHEN 3 THEN CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'lac' END WHEN 4 THEN 'glacier' WHEN 6 THEN 'grotte' END AS kind FROM part")
def _(spark, sf):
    return places(spark, sf).select("pid", S.kind_of(F.col("tags")).alias("kind"))


@query(
    "places_nearest",
    f"""WITH {PLACES}, j AS (SELECT s.seq AS id, pid, name, kind, {V.hav("s.lat", "s.lon", "b.lat", "b.lon")} AS d, m, {V.bear("b.lat", "b.lon", "s.lat", "s.lon")} AS brg FROM s JOIN b ON kind IS NOT NULL AND abs(s.lat - b.lat) < 0.02 WHERE {V.hav("s.lat", "s.lon", "b.lat", "b.lon")} <= 2000),
n AS (SELECT id, pid, arg_min(name, (d, m)) AS name, arg_min(kind, (d, m)) AS kind, min(d) AS d, arg_min(brg, (d, m)) AS brg FROM j GROUP BY 1, 2), u AS (SELECT *, row_number() OVER (PARTITION BY id, lower(name) ORDER BY d, pid) AS r FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, pid) AS place FROM u WHERE r = 1)
SELECT id, place, name, kind, round(d, 3) AS d, round(brg, 3) AS b FROM k WHERE place <= 3""",
)
def _(spark, sf):
    points = V.sightings(spark, sf).select(F.col("seq").alias("id"), "lat", "lon")
    return S.nearest_places(points, places(spark, sf)).select("id", F.col("place").cast("long").alias("place"), "name", "kind", F.round("d", 3).alias("d"), F.round("b", 3).alias("b"))


@query("municipality_fallback", f"WITH {V.SIGHTINGS} SELECT seq AS id, CASE WHEN seq % 4000 % 2 = 0 THEN 'A' || CAST(seq % 4000 AS VARCHAR) WHEN seq % 4000 % 3 = 0 THEN 'B' || CAST(seq % 4000 AS VARCHAR) END AS answer FROM s")
def _(spark, sf):
    from trailmark.functions.text import point_key

    # positions repeat every 4000 events, and so do the answers
    points = V.sightings(spark, sf).select(F.col("seq").alias("id"), "lat", "lon")
    keyed = points.select(point_key("lat", "lon").alias("key"), (F.col("id") % 4000).alias("n")).distinct()
    one = keyed.where("n % 2 = 0").select("key", F.concat(F.lit("A"), F.col("n").cast("string")).alias("name"))
    two = keyed.where("n % 3 = 0").select("key", F.concat(F.lit("B"), F.col("n").cast("string")).alias("name"))
    return S.first_answer(points, (one, "name"), (two, "name")).select("id", "answer")


def pins(spark, sf):
    s = V.sightings(spark, sf)
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("track").orderBy("t", "seq")) - 1
    return s.select("track", i.alias("i"), ((F.col("lon") - 5) * 300).alias("x"), ((F.col("lat") - 44) * 300).alias("y"))


@query("pin_groups")
def _(spark, sf):
    return S.pin_groups(pins(spark, sf)).select("track", "grp", "ids")


@query("pin_labels")
def _(spark, sf):
    return S.pin_groups(pins(spark, sf)).select("track", "grp", "label")


@query("profile_pin_groups")
def _(spark, sf):
    return S.profile_groups(pins(spark, sf).select("track", "i", (F.col("i") * 9).alias("x")))


VIEW = f"{V.SIGHTINGS}, p AS (SELECT track AS view, seq AS ord, round(lat, 1) AS lat, round(lon, 1) AS lon FROM s)"


@query("view_both", f"WITH {VIEW} SELECT view, min(ord) AS ord, lat, lon FROM p GROUP BY view, lat, lon")
def _(spark, sf):
    p = V.sightings(spark, sf).select(F.col("track").alias("view"), F.col("seq").alias("ord"), F.round("lat", 1).alias("lat"), F.round("lon", 1).alias("lon"))
    return S.both_view(p)


@query("view_focus", "WITH p AS (SELECT event_id // 2 AS view, event_id AS ord FROM events WHERE event_id % 5 <> 0), n AS (SELECT view, count(*) AS n, max(ord) AS ord FROM p GROUP BY 1) SELECT view, ord, 44.0::DOUBLE AS lat FROM p UNION ALL SELECT view, ord + 1, 45.0::DOUBLE FROM n WHERE n = 1")
def _(spark, sf):
    e = V.read(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("view"), F.col("event_id").alias("ord"), F.lit(44.0).alias("lat"), F.lit(5.0).alias("lon"))
    me = e.select("view", F.lit(45.0).alias("lat"), F.lit(6.0).alias("lon")).distinct()
    return S.focus_view(e.where("ord % 5 <> 0"), me).select("view", "ord", "lat")


@query("profile_nearest_sample", f"WITH {V.SIGHTINGS}, f AS (SELECT seq AS fid, track, CAST(seq % 4000 AS DOUBLE) AS x FROM s WHERE seq % 3 = 0), d AS (SELECT track, CAST(seq * 7 % 4000 AS DOUBLE) AS d FROM s) SELECT fid, f.track, arg_min(d, (abs(d - x), d)) AS d FROM f JOIN d ON f.track = d.track GROUP BY 1, 2")
def _(spark, sf):
    s = V.sightings(spark, sf)
    fingers = s.where("seq % 3 = 0").select(F.col("seq").alias("fid"), "track", (F.col("seq") % 4000).cast("double").alias("x"))
    return S.nearest_sample(s.select("track", (F.col("seq") * 7 % 4000).cast("double").alias("d")), fingers)
