import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, pivot string"


def brute(rows, k):
    ok = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in ok:
        if q % 100 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(hits, 1)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.2, (5, 16))
    out = [(i, (centres[i % 5] + rng.normal(0, 0.05, 16)).tolist()) for i in range(700)]
    hot = [0.25] * 16
    out += [(10_000 + i, hot) for i in range(300)]
    out += [(800, None), (900, []), (1000, [0.1] * 15 + [None]), (1100, [0.1] * 15 + [math.nan]), (1200, [math.inf] * 16), (None, hot), (1300, [0.5] * 3), (1301, [0.25] * 3), (-100, (-centres[0]).tolist()), (0, out[0][1]), (1400, [0.0] * 16)]
    return out


def run(spark, data, **options):
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in data], SCHEMA).repartition(4)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_equals_brute_force(spark, monkeypatch):
    data = rows()
    assert run(spark, data) == brute(data, 10)
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "PACK", 3)
    assert run(spark, data, k=3, pivots=4, annuli=3, sample=40) == brute(data, 3)


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0])]) == [(0, 1, 1, 1024 * 1024)]
    assert run(spark, []) == []


def test_large_values_stay_exact():
    a = np.array([[2**30, -(2**30) + 1]], np.int64)
    assert topk.products(a, a)[0, 0] == 2**60 + (2**30 - 1) ** 2

def brute_top(rows, k=10):
    """Of (vec_id, vector of integers) by Python's integers."""
    out = []
    for q, a in rows:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows if v != q)[:k]
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("power", [7, 19, 25, 28])
def test_search_of_large_components_equals_brute_force(spark, power):
    rng = np.random.default_rng(power)
    centre = rng.normal(0, 2.0**power, (9, 4))
    rows = [(i, (centre[i % 9] + rng.normal(0, 2.0 ** (power - 6), 4)).tolist()) for i in range(600)]
    if power > 19:  # scores of small queries and large vectors fit a long
        rows = [(i, [x / 2.0**power for x in v] if i % 100 == 0 else v) for i, v in rows]
    rows += [(1000, [3.0] * 4), (1003, [2.0**power] * 4), (1001, [2.0**power] * 4), (1100, [-7.0, 0.0, 1.0, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top([(i, [math.floor(1024 * x) for x in v]) for i, v in rows])


def test_scores_that_no_long_holds_raise(spark):
    frame = spark.createDataFrame([(i, [2.0**40] * 3) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.search(frame, F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="no exact scores"):
        topk.search(spark.createDataFrame([(1, [2.0**60])], "vec_id long, embedding array<double>"), F.col("vec_id") == 1).collect()
    # such a score that is no answer does no harm: the others come first
    rows = [(0, [2.0**40, 0.0]), (1, [-(2.0**40), 0.0])] + [(i, [i / 1024, 1.0]) for i in range(2, 20)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [19, 18, 17]


def test_answers_below_all_longs_raise_and_others_are_found(spark):
    far = [(0, [2.0**49])] + [(i, [-(2.0**50) - i]) for i in range(1, 13)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.search(spark.createDataFrame(far, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    near = far + [(20 + i, [i / 1024]) for i in range(10)]
    got = topk.search(spark.createDataFrame(near, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(29, 19, -1))
