"""The photo chain: what is read, what is not read again, frames, second tries, split winners."""

import pytest
from pyspark.sql import functions as F

from trailmark.operators import photo_chain as H, vote

WORDS = "array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>"
LINES = f"photo long, ord int, line int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, words {WORDS}"
GOOD, GLUED = "N 45°16.277' E 005°56.052'", "N 4516.277 E 00556.052"


def line(photo, ord_, n, text, words=None):
    return (photo, ord_, n, text, 60.0, 100.0, 500.0 + 100 * n, 900.0, 560.0 + 100 * n, words)


def views(spark, asked):
    rows = [line(1, 1, 0, GOOD), line(2, 1, 0, "menu"), line(2, 2, 0, GOOD), line(3, 1, 0, GLUED), line(3, 3, 0, GLUED), line(4, 1, 0, "menu"), line(4, 3, 0, GOOD)]
    lines = spark.createDataFrame(rows, LINES)

    def read(requests):
        got = requests.collect()
        asked.extend((r.photo, r.ord) for r in got)
        return lines.join(requests.select("photo", "ord"), ["photo", "ord"])

    return read


@pytest.fixture
def photos(spark):
    return spark.createDataFrame([(i, 4000.0, 3000.0, 0.0, False, i != 4) for i in range(1, 6)], "photo long, w double, h double, angle double, quad boolean, has_screen boolean")


def test_photos_with_a_clean_zone_are_not_read_again(spark, photos):
    asked = []
    zones = {r.photo: r for r in H.find_zones(photos, views(spark, asked)).collect()}
    assert sorted(asked) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (3, 4), (4, 1), (4, 2), (5, 1), (5, 2), (5, 3), (5, 4)]
    assert {p: (z.ord, z.views, z.clean) for p, z in zones.items()} == {1: (1, 1, True), 2: (2, 2, True), 3: (1, 4, False)}
    assert H.find_zones(photos.where("false"), views(spark, [])).collect() == []


def test_photos_given_up_meanwhile_are_asked_no_more(spark, photos):
    asked, calls = [], []

    def gone():
        calls.append(1)
        return photos.where("photo = 3" if len(calls) > 2 else "false")

    zones = H.find_zones(photos, views(spark, asked), gone).collect()
    assert {z.photo for z in zones} == {1, 2} and [a for a in asked if a[0] == 3] == [(3, 1), (3, 2)]


def test_zone_frames_coordinate_words_only(spark):
    word = lambda t, x, y: (t, 80.0 if t == "N" else 50.0, x, y, x + 100.0, y + 50.0)
    rows = [line(1, 1, 0, "Position GPS", [word("Position", 0.0, 0.0)]), line(1, 1, 1, "here N 45°16.277'", [word("here", 0.0, 500.0), word("N", 200.0, 500.0), word("45°16.277'", 400.0, 500.0)]), line(1, 1, 2, "E 005°56.052'"), line(1, 1, 3, "12 %", [word("12", 0.0, 900.0)])]
    z = H.coordinate_zones(spark.createDataFrame(rows, LINES), "photo", "ord").first()
    assert z.text == "here N 45°16.277'\nE 005°56.052'"
    assert tuple(z.box) == (100.0, 500.0, 900.0, 760.0)
    assert z.conf == round((80 * 1 + 50 * 10 + 60 * 12) / 23)


def test_frames_are_padded_widened_and_turned(spark, photos):
    zones = spark.createDataFrame([(1, True, (1000.0, 600.0, 3000.0, 900.0)), (2, False, (1000.0, 600.0, 3000.0, 900.0)), (3, True, (1000.0, 600.0, 3000.0, 900.0)), (4, True, (1000.0, 600.0, 3000.0, 900.0))], "photo long, clean boolean, box struct<x0:double,y0:double,x1:double,y1:double>")
    lean = spark.createDataFrame([(1, 0.3, 9.0), (2, 0.0, 9.0), (3, 5.0, 2.0), (4, 5.0, 1.4)], "photo long, deg double, gain double")
    got = {r.photo: (r.angle, tuple(r.box)) for r in H.frames(zones, photos, lambda requests: lean).collect()}
    pad = 105.0
    box = ((1000 - pad) / 4000, (600 - pad) / 3000, (2000 + 2 * pad) / 4000, (300 + 2 * pad) / 3000)
    assert got[1][0] == got[4][0] == 0 and got[1][1] == pytest.approx(box) == got[4][1]
    assert got[2][1] == pytest.approx((box[0] - box[2] * 0.15, max(0, box[1] - box[3]), box[2] * 1.3, min(1, box[1] + 2 * box[3]) - max(0, box[1] - box[3])))
    assert got[3][0] == -5.0 and got[3][1] != pytest.approx(box)


def test_passes_end_when_votes_are_firm_and_second_tries_are_kept_only_if_better(spark):
    boxes = spark.createDataFrame([(i, (0.4, 0.4, 0.2, 0.1)) for i in (1, 2, 3)], "photo long, box struct<x:double,y:double,w:double,h:double>")
    asked = []

    def read(requests):
        asked.extend((r.photo, r.which, r.pass_idx) for r in requests.collect())
        text = F.when(F.col("photo") == 1, GOOD).when((F.col("photo") == 2) & (F.col("which") == "wide"), GOOD).when(F.col("photo") == 2, "N 45°16.277'").when(F.col("which") == "wide", "menu").otherwise(F.concat(F.lit("N 45°1"), (F.col("pass_idx") % 6).cast("string"), F.lit(".277' E 005°56.052'")))
        words = F.array(F.struct(F.lit("N").alias("text"), F.lit(5.0).alias("confidence")), F.struct(F.lit("45").alias("text"), F.lit(91.4).alias("confidence")), F.struct(F.lit("'").alias("text"), F.lit(1.0).alias("confidence")))
        return requests.select("photo", "pass_idx", text.alias("txt"), words.alias("words"))

    got = {r.photo: r for r in H.read_found(boxes, read).collect()}
    assert {p: (r.which, r.total, r.sure, r.none) for p, r in got.items()} == {1: ("found", 3, True, False), 2: ("wide", 3, True, False), 3: ("found", 11, False, False)}
    assert [a[2] for a in sorted(asked) if a[:2] == (1, "found")] == [0, 1, 2] and len([a for a in asked if a[:2] == (3, "wide")]) == 6
    assert got[1].tess == 91 and tuple(got[2].box) == pytest.approx((0.37, 0.3, 0.26, 0.3))


def test_winners_of_two_readings_are_parsed_again(spark):
    alts = "array<struct<lat:double,lon:double>>"
    rows = [(1, i, "x", True, la, lo, "DMM", ["lat:symbol_degree"], [], t) for i, (la, lo, t) in enumerate([(45.1, 6.1, 10.2), (45.1, 6.2, 20.4), (45.2, 6.3, None), (45.3, 6.3, 40.0)])]
    r = vote.settle(spark.createDataFrame(rows, f"photo long, pass_idx int, txt string, ok boolean, lat double, lon double, fmt string, notes array<string>, alts {alts}, tess double")).first()
    assert (r.text, r.lat, r.lon, r.fmt, r.notes, r.total, r.agree) == ("45.100000, 6.300000", 45.1, 6.3, "DD", ["two_readings", "agreement"], 4, 2)
    assert r.tess == 24  # (10.2 + 20.4 + 40.0) / 3, rounded once


def test_read_loop_is_one_exchange_and_stops_where_prefixes_do(spark):
    alts = "array<struct<lat:double,lon:double>>"
    import random

    rng = random.Random(2)
    rows = [(p, i, "x", True, 45.0 + rng.choice([0, 0, 0.01]), 6.0 + rng.choice([0, 0, 0, 0.01]), "DD", ["n"] * rng.randint(0, 1), [], 1.0) for p in range(60) for i in range(rng.randint(1, 13))]
    df = spark.createDataFrame(rows, f"photo long, pass_idx int, txt string, ok boolean, lat double, lon double, fmt string, notes array<string>, alts {alts}, tess double")
    loop = vote.read_loop(df)
    plan = loop._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {r.photo: r.n for r in loop.groupBy("photo").agg(F.count("*").alias("n")).collect()}
    for p in range(60):
        own, n = [r for r in rows if r[0] == p and r[1] < 11], 0
        while n < len(own):
            n += 1
            prefix = spark.createDataFrame(own[:n], df.schema) if p < 6 else None
            if prefix is None or vote.with_firm(vote.axis_votes(prefix)).first().sure:
                break
        assert got[p] <= len(own) and (p >= 6 or got[p] == n)
