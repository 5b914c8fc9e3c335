"""The photo chain over a recogniser made of tables, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailmark.operators import photo_chain as H
from trailmark.plans import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def _position(photo, off):
    """N dd°mm.mmm' E ddd°mm.mmm' of a photo; ``off`` moves the latitude by 17 thousandths of a minute."""
    lat, lon = photo * 7919 % 59000 + off * 17, photo * 10473 % 60000
    minutes = lambda m: F.concat(F.lpad(F.floor(m / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"), F.lit("'"))
    return F.concat((44 + photo % 4).cast("string"), F.lit("°"), minutes(lat)), F.concat(F.lpad((5 + photo % 3).cast("string"), 3, "0"), F.lit("°"), minutes(lon))


def photos(spark, sf) -> DataFrame:
    p = F.col("event_id")
    return V.read(spark, sf, "events").select(p.alias("photo"), F.lit(4000.0).alias("w"), F.lit(3000.0).alias("h"), F.lit(0.0).alias("angle"), (p % 5 == 1).alias("quad"), (p % 7 != 0).alias("has_screen"))


def read_view(requests: DataFrame) -> DataFrame:
    """Three lines a view: a menu, and from some view on the two lines of the position, glued in every eleventh photo."""
    p, seen = F.col("photo"), F.col("ord") > F.col("photo") % 6
    lat, lon = _position(p, F.lit(0))
    glued = p % 11 == 0
    texts = F.array(F.lit("MENU"), F.when(seen, F.concat(F.lit("N "), F.when(glued, F.regexp_replace(lat, "[°']", "")).otherwise(lat))), F.when(seen, F.concat(F.lit("E "), F.when(glued, F.regexp_replace(lon, "[°']", "")).otherwise(lon))))
    rows = requests.select("photo", "ord", F.posexplode(texts).alias("line", "text"))
    word = F.transform(F.split("text", " "), lambda t, i: F.struct(t.alias("text"), (F.lit(50.0) + i * 20).alias("confidence"), (100.0 + i * 400).alias("x0"), (500.0 + F.col("line") * 100).alias("y0"), (400.0 + i * 400).alias("x1"), (560.0 + F.col("line") * 100).alias("y1")))
    return rows.withColumn("words", word).select("photo", "ord", "line", "text", F.lit(60.0).alias("confidence"), F.lit(100.0).alias("x0"), (500.0 + F.col("line") * 100).alias("y0"), F.lit(800.0).alias("x1"), (560.0 + F.col("line") * 100).alias("y1"), "words")


def read_lean(requests: DataFrame) -> DataFrame:
    return requests.select("photo", ((F.col("photo") % 9 - 4) * 0.3).alias("deg"), (1.0 + F.col("photo") % 4 * 0.25).alias("gain"))


def read_pass(requests: DataFrame) -> DataFrame:
    """A position a pass, moved in some passes; a fifth of the found boxes has its first line only."""
    p, i, found = F.col("photo"), F.col("pass_idx"), F.col("which") == "found"
    lat, lon = _position(p, F.when(found, (p + i) % 4 == 0).otherwise((p + i) % 7 == 0).cast("int"))
    word = lambda t, c: F.struct(t.alias("text"), c.cast("double").alias("confidence"))
    words = F.array(word(F.lit("N"), F.lit(10)), word(lat, (p * 31 + i) % 101), word(F.lit("E"), F.lit(5)), word(lon, (p * 17 + i * 3) % 101))
    half = found & (p % 5 == 0)
    return requests.select("photo", "pass_idx", F.when(half, F.concat(F.lit("N "), lat)).otherwise(F.concat(F.lit("N "), lat, F.lit("\nE "), lon)).alias("txt"), F.when(half, F.slice(words, 1, 2)).otherwise(words).alias("words"))


ORACLES["photo_chain"] = """WITH p AS (SELECT event_id AS photo, event_id % 6 + 1 AS first, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 4 END AS most FROM events),
z AS (SELECT *, first <= most AS found, first <= most AND photo % 11 <> 0 AS clean FROM p),
box(which, passes) AS (VALUES ('found', 11), ('wide', 6)),
r AS (SELECT photo, which, passes, i, CASE WHEN which = 'found' THEN (photo + i) % 4 = 0 ELSE (photo + i) % 7 = 0 END AS off, NOT (which = 'found' AND photo % 5 = 0) AS ok FROM z, box, generate_series(0, 10) AS g(i) WHERE found AND i < passes),
c AS (SELECT *, count(*) FILTER (off) OVER w AS moved, count(*) FILTER (NOT off) OVER w AS plain FROM r WHERE ok WINDOW w AS (PARTITION BY photo, which ORDER BY i)),
s AS (SELECT photo, which, min(i) AS stop FROM c WHERE greatest(moved, plain) >= 3 AND least(moved, plain) <= greatest(moved, plain) - 2 GROUP BY 1, 2),
k AS (SELECT r.*, s.stop IS NOT NULL AS sure FROM r LEFT JOIN s USING (photo, which) WHERE i <= coalesce(stop, 10)),
g AS (SELECT photo, which, sure, off, ok, count(*) AS n, min(i) AS idx FROM k WHERE ok GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY photo, which ORDER BY n DESC, idx) AS place FROM g),
t AS (SELECT photo, which, count(*) AS total FROM k GROUP BY 1, 2),
v AS (SELECT t.photo, t.which, total, coalesce(bool_or(sure), false) AS sure, count(o.n) = 0 AS none, max(CASE WHEN place = 1 THEN n END) AS n1, max(CASE WHEN place = 2 THEN n END) AS n2, max(CASE WHEN place = 1 THEN off::INT END) AS off, max(CASE WHEN place = 1 THEN idx END) AS idx FROM t LEFT JOIN o USING (photo, which) GROUP BY ALL),
b AS (SELECT f.photo, NOT f.sure AND (w.sure OR (f.none AND NOT w.none)) AS wide, f.none AS none1, w.none AS none2 FROM v f JOIN v w ON w.photo = f.photo AND f.which = 'found' AND w.which = 'wide'),
u AS (SELECT v.* FROM b JOIN v ON v.photo = b.photo AND v.which = CASE WHEN wide THEN 'wide' ELSE 'found' END),
e AS (SELECT *, coalesce(n2 >= n1, false) AS rival, (NOT sure)::INT AS notes, (NOT sure AND n2 IS NOT NULL)::INT AS alts, CAST(floor(((photo * 31 + idx) % 101 * 10 + (photo * 17 + idx * 3) % 101 * 11) / 21.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS tess FROM u),
h AS (SELECT *, (CASE WHEN sure THEN 88 + least(7.0::DOUBLE, 2.0::DOUBLE * greatest(0, n1 - 3)) ELSE 75.0::DOUBLE * n1 / total END + greatest(-10, least(5, (tess - 60) / 4.0::DOUBLE))) * CASE WHEN rival THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN notes > 0 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN alts > 0 AND NOT rival THEN 0.8::DOUBLE ELSE 1 END AS raw FROM e),
q AS (SELECT *, CAST(greatest(0, least(100, floor(raw + 0.5::DOUBLE))) AS INTEGER) AS pct FROM h),
d AS (SELECT photo, (photo % 9 - 4) * 0.3::DOUBLE AS deg, photo % 4 >= 2 AS sharp FROM z)
SELECT z.photo, z.found, CASE WHEN z.found THEN CAST(z.first AS INTEGER) END AS ord, CASE WHEN z.found THEN CASE WHEN clean THEN z.first ELSE most END END AS views, CASE WHEN z.found THEN clean END AS clean,
  CASE WHEN z.found AND sharp AND abs(photo % 9 - 4) >= 2 THEN floor(-deg * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS angle, q.which, round(44 + photo % 4 + (photo * 7919 % 59000 + off * 17) / 60000.0::DOUBLE, 6) AS lat, CASE WHEN q.photo IS NOT NULL THEN round(5 + photo % 3 + (photo * 10473 % 60000) / 60000.0::DOUBLE, 6) END AS lon,
  CAST(q.n1 AS INTEGER) AS agree, q.total, q.tess, q.sure, q.rival, q.pct, CASE WHEN q.sure AND pct >= 70 THEN 'ok' WHEN q.photo IS NOT NULL THEN 'check' END AS level, CASE WHEN q.photo IS NULL THEN 'none' WHEN q.sure AND pct >= 70 THEN 'ok' ELSE 'check' END AS st
FROM z JOIN d USING (photo) LEFT JOIN q USING (photo)"""


def photo_chain(spark, sf):
    rows = H.photo_chain(photos(spark, sf), read_view, read_lean, read_pass)
    return rows.select("photo", "found", "ord", "views", "clean", F.round("angle", 1).alias("angle"), "which", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "agree", "total", "tess", "sure", "rival", "pct", "level", "st")


QUERIES["photo_chain"] = photo_chain
