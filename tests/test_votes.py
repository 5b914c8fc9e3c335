from pyspark.sql import functions as F

from trailmark.operators import spatial as S, vote as O

SCHEMA = "photo int, pass_idx int, txt string, ok boolean, lat double, lon double, fmt string, notes array<string>, alts array<struct<lat:double,lon:double>>, tess double"


def frame(spark, lats, lon=6.0, notes=()):
    return spark.createDataFrame([(1, i, f"t{i}", x is not None, x, lon if x is not None else None, "DD", ["n"] if i in notes else [], [], 80.0) for i, x in enumerate(lats)], SCHEMA)


def one(df):
    return O.with_firm(O.axis_votes(df)).first()


def test_three_equal_readings_are_firm(spark):
    r = one(frame(spark, [45.1, 45.1, 45.1]))
    assert r.sure and r.lat_best.n == 3 and r.lat_second is None and r.total == 3


def test_values_within_tolerance_vote_together_and_the_most_read_leads(spark):
    r = one(frame(spark, [45.100000, 45.100015, 45.100015, 45.100030]))
    # the group's value moves to 45.100015, so the last reading still joins
    assert r.lat_best.n == 4 and r.lat_best.v == 45.100015


def test_order_of_readings_matters(spark):
    r = one(frame(spark, [45.100000, 45.100030, 45.100015, 45.100015]))
    assert r.lat_best.n == 3 and r.lat_second.n == 1


def test_two_against_two_is_not_sure(spark):
    r = one(frame(spark, [45.1, 45.2, 45.1, 45.2]))
    assert not r.sure and r.rival and r.lat_best.v == 45.1


def test_readings_outside_the_region_do_not_vote(spark):
    r = one(frame(spark, [45.1, 45.1, 10.0, None]))
    assert r.lat_best.n == 2 and r.lat_second is None and r.total == 4


def test_reader_stops_at_the_first_firm_prefix(spark):
    kept = O.read_loop(frame(spark, [45.1, 45.2, 45.1, 45.1, 45.1, 45.1, 45.1]))
    assert sorted(r.pass_idx for r in kept.collect()) == [0, 1, 2, 3]


def test_settled_readings(spark):
    sure = O.settle(frame(spark, [45.1, 45.1, 45.1], notes={0})).first()
    assert sure.sure and sure.text == "t1" and sure.notes == [] and sure.agree == 3 and sure.tess == 80
    doubt = O.settle(frame(spark, [45.1, 45.1, 45.2])).first()
    assert not doubt.sure and doubt.notes == ["agreement"] and [(a.lat, a.lon) for a in doubt.alts] == [(45.2, 6.0)]
    none = O.settle(frame(spark, [None, None])).first()
    assert none.none and none.text == "t0" and none.lat is None


def test_pins_and_places(spark):
    pins = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 100.0, 0.0), (1, 2, 110.0, 5.0), (2, 0, 0.0, 0.0), (2, 1, 50.0, 0.0), (2, 2, 20.0, 0.0)], "track int, i int, x double, y double")
    groups = {t: [] for t in (1, 2)}
    for r in S.pin_groups(pins).orderBy("track", "grp").collect():
        groups[r.track].append(r.ids)
    assert groups == {1: [[0], [1, 2]], 2: [[0, 2], [1]]}


def test_pin_folds_equal_the_plain_rule():
    import math
    import random

    rng = random.Random(3)
    xs = [{"i": i, "x": rng.uniform(-300, 300), "y": rng.uniform(-300, 300)} for i in range(900)] + [{"i": 900, "x": None, "y": 0.0}, {"i": 901, "x": math.nan, "y": 0.0}, {"i": 902, "x": 0.0, "y": 0.0}]
    want = []
    for p in xs:
        near = [g for g in want if None not in (g[0]["x"], p["x"]) and math.hypot(g[0]["x"] - p["x"], g[0]["y"] - p["y"]) < 34]
        near[0].append(p) if near else want.append([p])
    assert S.pin_fold(xs, 34) == [[p["i"] for p in g] for g in want]
    assert S.profile_fold([{"i": i, "x": x} for i, x in enumerate([0.0, 5.0, 12.0, None, 13.0, 14.0])], 10) == [[0, 1], [2], [3], [4, 5]]


def test_pin_and_edit_queries_read_all_rows(spark):
    from tests.compare import DATA
    from trailmark.plans import registry

    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    run = lambda name: registry.QUERIES[name](spark, DATA)
    assert run("digit_edits").count() == n
    for name in ("pin_groups", "profile_pin_groups"):
        found = [(r.track, i) for r in run(name).collect() for i in r.ids]
        assert len(found) == len(set(found)) == n
    assert run("pin_labels").count() == run("pin_groups").count()


def test_radius_join_equals_brute_force_everywhere(spark):
    from trailmark.operators.parse import distance_m

    here = [(i, -90 + (i * 37 % 1801) / 10, -180 + (i * 91 % 3600) / 10) for i in range(300)] + [(900, 10.0, 179.999), (901, 89.95, 20.0), (902, 0.0, -180.0)]
    there = [(i, la + 0.01 * (i % 3 - 1), lo + 0.01 * (i % 5 - 2)) for i, la, lo in here] + [(950, 10.0, -179.999), (951, 89.95, -150.0), (952, 0.0, 180.0)]
    there = [(i, max(-90.0, min(90.0, la)), lo) for i, la, lo in there]
    df = lambda rows: spark.createDataFrame(rows, "id int, lat double, lon double")
    for radius in (2000.0, 15000.0):
        got = sorted((r.id, r.p_id) for r in S.radius_join(df(here), df(there), radius).collect())
        want = sorted((a, b) for a, la, lo in here for b, pa, po in there if distance_m((la, lo), (pa, po)) <= radius)
        assert got == want


def test_nearest_places(spark):
    tags = lambda **k: {a.replace("__", ":"): b for a, b in k.items()}
    places = [(1, tags(natural="saddle", name="Col A"), [(45.0, 6.005)]), (2, tags(mountain_pass="yes", name="COL A"), [(45.0, 6.004)]), (3, tags(natural="water", name="Lac"), [(45.5, 6.0), (45.001, 6.0)]), (4, tags(amenity="bench", name="Banc"), [(45.0, 6.0)]), (5, tags(natural="peak", name="Pic", name__fr="Le Pic"), [(45.0, 6.01)])]
    df = spark.createDataFrame(places, "pid int, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    rows = S.nearest_places(spark.createDataFrame([(7, 45.0, 6.0)], "id int, lat double, lon double"), df).orderBy("place").collect()
    assert [(r.name, r.kind) for r in rows] == [("Lac", "lac"), ("COL A", "col"), ("Le Pic", "sommet")]
    assert round(rows[0].b) == 180


def test_best_zone_prefers_fewer_lines(spark):
    lines = [(1, i, t, 0, 20 * i) for i, t in enumerate(["Menu", "Alt 1200 m", "N 45°16.277'", "E 005°56.052'", "12:30"])]
    z = O.best_zone(spark.createDataFrame(lines, "page int, line int, text string, x0 int, y0 int")).first()
    assert (z.i, z.k) == (2, 2) and z.p.best.fmt == "DMM"


def test_words_confidence(spark):
    words = spark.createDataFrame([(1, "Menu", 10.0), (1, "N", 90.0), (1, "45°16.277'", 75.0), (1, "12", None)], "id int, text string, confidence double")
    assert O.words_confidence(words, "id").first().confidence == int((90 + 75 * 10) / 11 + 0.5)
    assert O.words_confidence(words.where(F.col("text") == "Menu"), "id").first().confidence is None


def test_folds_of_many_photos_equal_the_plain_rule(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(5)
    values = [45.1, 45.100015, 45.10003, 45.1000005, 45.1000015, 45.2, 10.0, None]
    rows = [(p, i, "t", True, rng.choice(values), 6.0, "DD", ["n"] * rng.randint(0, 1), [], 1.0) for p in range(400) for i in range(rng.choice([1, 3, 11, 11, 40]))]
    six = lambda v: float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP))

    def plain(photo):
        groups = []
        for _, i, _, _, v, _, _, notes, _, _ in photo:
            if v in (None, 10.0):
                continue
            w = 0.6 if notes else 1.0
            g = next((g for g in groups if abs(g["v"] - v) < 0.00002), None)
            if g is None:
                groups.append(g := {"v": six(v), "w": 0.0, "runs": [], "vals": {}})
            g["vals"][six(v)] = g["vals"].get(six(v), 0.0) + w
            g["v"], g["w"] = max(g["vals"], key=g["vals"].get), g["w"] + w
            g["runs"].append(i)
        return [(g["v"], round(g["w"], 9), len(g["runs"]), g["runs"]) for g in sorted(groups, key=lambda g: -g["w"])[:2]]

    votes = O.axis_votes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "aggregate(" not in plan  # no fold in an expression
    for r in votes.collect():
        got = [(g.v, round(g.w, 9), g.n, list(g.runs)) for g in (r.lat_best, r.lat_second) if g]
        assert got == plain([x for x in rows if x[0] == r.photo]), r.photo


def test_photos_stay_whole_above_a_join_on_their_keys(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.createDataFrame([(p, i, "t", True, 45.1, 6.0, "DD", [], [], 1.0) for p in range(50) for i in range(5)], SCHEMA).repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        votes = O.axis_votes(rows.join(rows.select("photo").distinct(), "photo", "left_semi"))
        assert "hashpartitioning(xxhash64(photo" in votes._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.photo, r.total, r.lat_best.n) for r in votes.collect()) == [(p, 5, 5) for p in range(50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
