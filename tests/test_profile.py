from trailmark.operators.profile import profile_rows, scales

SCHEMA = "track long, i long, d double, z double, k long"


def rows(spark, samples):
    return [r for r in profile_rows(spark.createDataFrame(samples, SCHEMA)).collect()]


def test_scale_ticks_outline_ends_and_pins(spark):
    samples = [(1, 0, 0.0, 1280.0, 0), (1, 1, 100.0, None, -1), (1, 2, 200.0, 1460.0, 1), (1, 3, 205.0, 1467.0, 2), (1, 4, 1000.0, 1500.0, 3)]
    s = scales(spark.createDataFrame(samples, SCHEMA)).first()
    assert (s.y0, s.y1, s.step, s.dmax) == (1200.0, 1500.0, 100.0, 1000.0)
    got = rows(spark, samples)
    by = lambda kind: sorted((r for r in got if r.kind == kind), key=lambda r: r.ord)
    assert [(r.y, r.label) for r in by("tick")] == [(174.0, "1 200"), (123.3, "1 300"), (72.7, "1 400"), (22.0, "1 500")]
    assert [(r.ord, r.y, r.y2) for r in by("line")] == [(60, 133.5, 133.5), (162, 42.3, 42.3), (165, 38.7, 38.7), (574, 22.0, 22.0)]
    assert [(r.x, r.label) for r in by("end")] == [(60.0, "0"), (574.0, "1,00 km")]
    assert [(r.label, r.x, r.text, r.shown) for r in by("pin")] == [("1", 60.0, "1 280", True), ("2-3", 162.8, "1 460-1 467", True), ("4", 574.0, "1 500", True)]


def test_flat_tracks_are_widened_and_short_ones_have_no_profile(spark):
    flat = spark.createDataFrame([(1, i, i * 10.0, 500.0, -1) for i in range(3)] + [(2, 0, 0.0, 5.0, 0), (2, 1, 9.0, None, 1)], SCHEMA)
    assert [(s.track, s.y0, s.y1, s.step) for s in scales(flat).collect()] == [(1, 490.0, 510.0, 5.0)]
    assert {r.track for r in profile_rows(flat).collect()} == {1}


def test_outline_is_bounded_by_the_drawing(spark):
    many = spark.range(20000).selectExpr("1L AS track", "id AS i", "id * 1.0D AS d", "CAST(id * 37 % 900 AS DOUBLE) AS z", "-1L AS k")
    line = [r for r in profile_rows(many).collect() if r.kind == "line"]
    assert len(line) <= 515 and all(r.y <= r.y2 for r in line)
