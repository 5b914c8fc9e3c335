import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from trailmark.functions import geo as G, text as T
from trailmark.operators import track as K, trust as U
from trailmark.sources import tracks as S

DAY = dt.datetime(2026, 11, 1, 8)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


@pytest.fixture()
def points(spark):
    rows = [(1, 1, at(0), 45.0, 6.0, "seen", "n"), (1, 2, at(9.5), 45.01, 6.0, "", "n"), (1, 3, at(25), 45.01, 6.02, "a & b ~", "n"), (2, 4, at(0), 44.0, 5.0, None, None)]
    return spark.createDataFrame(rows, "track long, seq long, t timestamp, lat double, lon double, label string, name string")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_summary_of_one_and_three_points(points):
    rows = {r.track: r for r in K.summary(points).collect()}
    assert rows[1].n == 3 and rows[1].dt == 25 * 3600000 and 2600 < rows[1].total < 2750 and rows[1].v == pytest.approx(rows[1].total / 25)
    assert (rows[2].n, rows[2].total, rows[2].v, rows[2].direct, rows[2].bearing, rows[2].last_d) == (1, 0, None, 0, None, None)


def test_speed_needs_ten_minutes(spark):
    rows = [(1, i, at(h), 45.0 + i / 100, 6.0) for i, h in enumerate((0, 0.1, 0.1, 1))]
    df = spark.createDataFrame(rows, "track long, seq long, t timestamp, lat double, lon double")
    assert [r.v is None for r in K.legs(df).orderBy("i").collect()] == [True, True, False]


def test_links_and_gpx_round_trip(points):
    want = [(round(r.lat, 6), round(r.lon, 6), r.label or "") for r in points.where("track = 1").orderBy("t").collect()]
    gpx = K.from_gpx(K.to_gpx(points).withColumnRenamed("track", "id")).where("id = 1").orderBy("seq").collect()
    assert [(r.lat, r.lon, r.label) for r in gpx] == want and gpx[0].t == int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    links = K.decode_links(K.encode_links(points.withColumn("label", F.replace(F.col("label"), F.lit("~"), F.lit("-")))).withColumnRenamed("track", "id")).where("id = 1").orderBy("seq").collect()
    assert [(r.lat, r.lon, r.label) for r in links] == [(a, b, c.replace("~", "-")) for a, b, c in want]


def test_link_reader_is_lenient(spark):
    links = spark.createDataFrame([(1, "#s=Zoé%20x~45.1,6.2,100,ici~bad,6,1,~95,6,1,~45.2,6.3,200,%E0"), (2, "#45.1,6.2"), (3, None)], "id int, hash string")
    rows = K.decode_links(links).orderBy("seq").collect()
    assert [(r.name, r.lat, r.t, r.label) for r in rows] == [("Zoé x", 45.1, 100000, "ici"), ("Zoé x", 45.2, 200000, "%E0")]


def test_foreign_gpx(spark):
    text = '<gpx><metadata><name> A &amp;lt; B </name></metadata><trk><trkseg><trkpt lat="45.1" lon="6.1"/><trkpt lat="45.2" lon="6.2"><time>2026-11-01T08:00:00Z</time></trkpt><trkpt lat="145" lon="6"/></trkseg></trk></gpx>'
    rows = S.import_files(spark.createDataFrame([("f", text), ("g", "see #s=n~45,6,10,x here"), ("h", "nothing")], "id string, text string")).orderBy("id", "seq").collect()
    assert [(r.id, r.name, r.lat, r.t) for r in rows] == [("f", "A &lt; B", 45.1, 0), ("f", "A &lt; B", 45.2, 1793520000000), ("g", "n", 45.0, 10000)]


def test_merge_is_ordered_and_idempotent(spark):
    schema = "track long, seq long, t timestamp, lat double, lon double, label string"
    a = spark.createDataFrame([(1, 1, at(0), 45.0, 6.0, "a"), (1, 2, at(0), 45.0, 6.0, "kept twice")], schema)
    minute = dt.timedelta(seconds=59)
    b = spark.createDataFrame([(1, 11, at(0) + minute, 45.00001, 6.0, "dup of a"), (1, 12, at(1), 45.0, 6.0, "b1"), (1, 13, at(1) + minute, 45.0, 6.0, "dup of b1"), (1, 14, at(1) + 2 * minute, 45.0, 6.0, "near 13 only")], schema)
    merged = K.merge(a, b)
    assert sorted(r.seq for r in merged.collect()) == [1, 2, 12, 14]
    again = K.merge(merged.select("track", "seq", "t", "lat", "lon", "label"), b)
    assert sorted(r.seq for r in again.collect()) == [1, 2, 12, 14]


def test_climbs_skip_unknown_altitudes(spark):
    zs = [1280.0, 1460.0, 1440.0, None, 1500.0]
    df = spark.createDataFrame([(1, i, at(i), z) for i, z in enumerate(zs)], "track long, seq long, t timestamp, z double")
    r = K.climb_totals(df).first()
    assert (r.up, r.down) == (180.0, 20.0)


def test_texts(spark):
    v = lambda c: value(spark, c)
    assert v(T.dmm_text(F.lit(45.9999999), True)) == "N 46°00.000'" and v(T.dms_text(F.lit(45.9999999), True)) == "N 46°00'00.0\""
    assert v(T.duration_text(F.lit(34380000))) == "9 h 33" and v(T.duration_text(F.lit(-5))) == "0 min" and v(T.duration_text(F.lit(187200000))) == "2 j 4 h"
    assert v(T.distance_text(F.lit(999.4))) == "999 m" and v(T.distance_text(F.lit(1234.0))) == "1,23 km" and v(T.distance_text(F.lit(12345.0))) == "12,3 km"
    assert v(T.delta_text(F.lit(-1234.0))) == "−1\u202f234 m" and v(T.delta_text(F.lit(0.2))) == "±0 m"
    assert v(T.pin_label(F.array(F.lit(1), F.lit(2), F.lit(3)))) == "2-4" and v(T.pin_label(F.array(F.lit(1), F.lit(4)))) == "2,5"
    assert v(T.uri_component(F.lit("a b!~(é)"))) == "a%20b!~(%C3%A9)"
    assert v(G.utm_zone(F.lit(180.0))) == 61


def test_orientation(spark):
    v = lambda c: value(spark, c)
    assert v(G.heading(0.0, 0.0, 0.0)) == pytest.approx(0, abs=1e-9) and v(G.heading(90.0, 0.0, 0.0)) == pytest.approx(270)
    assert v(G.pitch(F.lit(90.0), F.lit(0.0))) == pytest.approx(0, abs=1e-9) and v(G.pitch(F.lit(120.0), F.lit(0.0))) == pytest.approx(30)
    assert v(G.turn(F.lit(10.0), F.lit(350.0))) == 20 and v(G.turn(F.lit(350.0), F.lit(10.0))) == -20
    assert v(G.route_check(F.lit(math.nan), F.lit(6.0))).code == "invalid" and v(G.route_check(F.lit(6.0), F.lit(45.0))).swap


GOLDEN = [
    ((90, 3, 3, True, False, 0, 0, False), 93, "ok"), ((90, 6, 8, True, False, 0, 0, False), 99, "ok"), ((50, 3, 3, True, False, 0, 0, False), 86, "ok"), ((None, 2, 5, False, False, 0, 0, False), 30, "check"),
    ((None, None, None, False, False, 0, 0, True), 100, "ok"), ((None, None, None, False, False, 1, 0, False), 80, "check"), ((None, 0, 0, False, False, 0, 0, False), 0, "check"), ((90, 3, 6, True, True, 0, 1, False), 56, "check"),
]


def test_trust(spark):
    schema = "tess double, n int, total int, firm boolean, rival boolean, notes int, alts int, manual boolean"
    df = spark.createDataFrame([(float(a[0]) if a[0] is not None else None, *a[1:]) for a, *_ in GOLDEN], schema)
    rows = df.select(U.confidence(*[F.col(c) for c in df.columns]).alias("t")).collect()
    assert [(r.t.pct, r.t.level) for r in rows] == [x[1:] for x in GOLDEN]


def test_doubt_stays_until_verified(spark):
    rows = [(1, 1, True, True, False, 55, "check"), (1, 2, True, False, False, 100, "ok"), (1, 3, True, False, False, 100, "ok"), (1, 4, True, False, True, 100, "ok"), (1, 5, True, False, False, 100, "ok")]
    out = U.carry_doubt(spark.createDataFrame(rows, "chain int, seq int, ok boolean, ocr boolean, verified boolean, pct int, level string")).orderBy("seq").collect()
    assert [(r.pct, r.level) for r in out] == [(55, "check"), (55, "check"), (55, "check"), (100, "ok"), (100, "ok")]
