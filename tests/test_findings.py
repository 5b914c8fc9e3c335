"""Cases that a review found: ranks of placed points, places near repeated positions, texts that repeat."""

import datetime as dt

from pyspark.sql import functions as F

from trailmark.operators import parse as P, parse_columns as N, spatial as S, track as K, vote as O

READING = "photo long, pass_idx int, txt string, ok boolean, lat double, lon double, fmt string, notes array<string>, alts array<struct<lat:double,lon:double>>, tess double"
T0 = dt.datetime(2026, 1, 1, 12)
POINTS = "track long, seq long, t timestamp, lat double, lon double, key string"
QUERIES = "qid long, track long, t timestamp, lat double, lon double, key string, dated boolean"


def test_a_duplicate_has_the_rank_of_the_point_that_it_repeats(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    points = spark.createDataFrame([(1, 1, at(0), 45.0, 6.0, None), (1, 2, at(10), 46.0, 6.0, None)], POINTS)
    r = K.put_points(points, spark.createDataFrame([(9, 1, at(20), 45.0, 6.0, None, False)], QUERIES)).first()
    assert (r.how, r.seq, r.rank) == ("dup", 1, 1)


def test_ranks_count_dates_to_the_millisecond(spark):
    at = lambda us: T0 + dt.timedelta(microseconds=us)
    points = spark.createDataFrame([(1, 1, at(700), 45.0, 6.0, None), (1, 2, at(300), 46.0, 6.0, "k")], POINTS)
    r = K.put_points(points, spark.createDataFrame([(9, 1, at(0), 47.0, 6.0, "k", False)], QUERIES)).first()
    assert (r.how, r.rank) == ("moved", 2)


def places_near(spark):
    tags = {"natural": "peak", "name": "A"}
    return spark.createDataFrame([(1, tags, [(45.0, 6.005)])], "pid int, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")


def test_places_are_looked_up_once_a_position(spark):
    points = spark.createDataFrame([(i, 45.0, 6.0) for i in range(50)] + [(50, None, None)], "id int, lat double, lon double")
    asked = []
    out = S.at_spots(points, lambda spots: asked.append(spots.count()) or spots.select("id", F.lit(1).alias("place")))
    assert asked == [1] and out.count() == 50
    assert [(r.id, r.name) for r in S.nearest_places(points, places_near(spark)).orderBy("id").collect()] == [(i, "A") for i in range(50)]


def test_cells_of_places_are_not_broadcast(spark):
    points = spark.createDataFrame([(1, 45.0, 6.0)], "id int, lat double, lon double")
    plan = S.met_places(points, S.named_places(places_near(spark)), 2000.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_utm_that_rounds_beyond_the_date_line_is_a_position(spark):
    texts = ["1T 0243900 4432069", "1N 0166021 0000000", "1T 0100000 4432069"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", N.parse_plain("text").alias("p"), P.parse_position("text").alias("q")).collect()
    for r in rows:
        assert r.p.ok == r.q.ok == (r.text != texts[2])
        if r.p.ok:
            assert 179.9999 < r.p.best.lon <= 180 and abs(r.p.best.lon - r.q.best.lon) < 1e-9 and r.p.best.fmt == r.q.best.fmt


def test_equal_texts_are_parsed_once_and_every_row_has_its_parse(spark):
    texts = ["45.271283 5.934200"] * 40 + [None] * 3 + ["none", "45.371283 5.834200"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("struct<lat:double>")
    def counted(text):
        seen.add(1)
        return (float(text.split()[0]),) if text and text != "none" else (None,)

    got = {r.id: r.p.lat for r in P.parse_once(df, parser=counted).collect()}
    assert seen.value == 4 and got == {i: float(t.split()[0]) if t and t != "none" else None for i, t in enumerate(texts)}


def test_settling_reads_its_rows_once(spark):
    rows = spark.createDataFrame([(1, i, "45.271283, 5.934200", True, 45.271283, 5.9342, "DD", [], [], 80.0) for i in range(3)], READING)
    plan = O.settle(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    assert tuple(O.settle(rows).select("sure", "agree", "fmt", "tess").first()) == (True, 3, "DD", 80)
