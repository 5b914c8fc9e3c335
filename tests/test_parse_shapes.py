"""Texts parsed by their shapes give what single texts give."""

import random
import re

from pyspark.sql import functions as F

from tests.compare import DATA
from tests.test_parse_columns import flat, many
from trailmark.operators import parse as P, parse_columns as N, parse_shapes as H
from trailmark.plans import reading_queries


def test_parses_by_shape_are_equal(spark):
    rng = random.Random(5)
    digits = lambda t: re.sub("[0-9]", lambda m: rng.choice("0012345" + m[0] * 6), t)
    texts = [t for t in many() if t is not None]
    texts = [None, *dict.fromkeys([*texts, *(digits(t) for t in texts for _ in range(3)), "45.271283 5.934200 " + "x " * 200])]
    got = H.parse_texts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), "text").collect()
    assert len(got) == len(texts) and {r.text for r in got} == set(texts)
    for r in got:
        assert flat(r.p.asDict(True)) == flat(P.parse(r.text)), r.text


def test_texts_that_differ_in_their_digits_only_need_no_parse_of_their_own(spark):
    five = lambda c: F.lpad(c.cast("string"), 5, "0")
    df = spark.range(3000).select("id", F.concat(F.lit("GPS 45."), five(F.col("id")), F.lit(", 5."), five(F.col("id") * 7)).alias("text"))
    fail = lambda c: F.raise_error(F.concat(F.lit("parsed by itself: "), c)).cast(N.RESULT)
    got = {r.id: r for r in H.all_positions(df, parser=fail).where("rank = 0").collect()}
    assert len(got) == 3000 and all(abs(r.lat - 45 - i / 1e5) < 1e-9 and abs(r.lon - 5 - i * 7 / 1e5) < 1e-9 and r.fmt == "DD" for i, r in got.items())


def test_the_query_of_alternatives_parses_by_shape(spark):
    plan = reading_queries.QUERIES["parse_alternatives"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert ", [0-9], 9, " in plan and "NestedLoop" not in plan and "Cartesian" not in plan
