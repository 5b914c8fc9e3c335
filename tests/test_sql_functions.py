from pyspark.sql import functions as F

from trailmark.functions import geo as G
from trailmark.functions.register import register
from trailmark.operators import parse as P, track as K


def test_sql_names(spark):
    register(spark)
    r = spark.sql("SELECT round(haversine_m(45, 6, 45.01, 6), 1) d, haversine_m(NULL, 6, 45, 6) n, bearing_deg(45, 6, 46, 6) b, in_region(45, 6) i, turn_deg(10, 350) t, parse_position('45.271283, 5.934200').best.fmt f").first()
    assert (r.d, r.n, r.b, r.i, r.t, r.f) == (1112.0, None, 0.0, True, 20.0, "DD")
    rows = spark.sql("SELECT rank, fmt FROM parse_positions('45.271283 5.934200 then 45.371283 5.834200') ORDER BY rank").collect()
    assert [tuple(r) for r in rows] == [(0, "DD"), (1, "DD")]


def test_boxes(spark):
    one = lambda c: spark.range(1).select(c.alias("b")).first().b
    box = F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", (0.1, 0.2, 0.3, 0.4))])
    size = F.struct(F.lit(200.0).alias("w"), F.lit(100.0).alias("h"))
    turned = one(G.turn_box(box, size, G.rotated_size(F.lit(200.0), F.lit(100.0), F.lit(90.0)), F.lit(90.0)))
    # the centre (50, 40) of the image lies at (60, 50) of the turned one; 60 by 40 pixels stay so
    assert [round(v, 6) for v in turned] == [0.3, 0.15, 0.6, 0.2]
    assert [round(v, 6) for v in one(G.rotated_size(F.lit(200.0), F.lit(100.0), F.lit(90.0)))] == [100, 200]
    assert [round(v, 6) for v in one(G.fit_box(F.lit(0.9), F.lit(-0.2), F.lit(0.3), F.lit(0.4)))] == [0.7, 0.0, 0.3, 0.4]


def test_edits_and_rank(spark):
    edits = spark.createDataFrame([(1, "N 45°16.277' E 005°56.052'", 12, "8", 45.271283, 5.9342), (2, "N 45°16.277' E 005°56.052'", 6, "9", 45.271283, 5.9342)], "id int, text string, at int, char string, lat double, lon double")
    rows = {r.id: r for r in P.preview_edits(edits).collect()}
    assert rows[1].accepted and 0 < rows[1].moved < 20 and not rows[2].accepted
    import datetime as dt

    at = lambda h: dt.datetime(2026, 1, 1, h)
    points = spark.createDataFrame([(1, 1, at(1), 45.0, 6.0, None), (1, 2, at(5), 45.1, 6.0, "k")], "track long, seq long, t timestamp, lat double, lon double, key string")
    q = spark.createDataFrame([(9, 1, at(3), 45.2, 6.0, None, False)], "qid long, track long, t timestamp, lat double, lon double, key string, dated boolean")
    r = K.put_points(points, q).first()
    assert (r.how, r.rank) == ("added", 2)
    moved = spark.createDataFrame([(9, 1, at(0), 45.2, 6.0, "k", True)], q.schema)
    assert tuple(K.put_points(points, moved).select("how", "rank").first()) == ("moved", 1)
