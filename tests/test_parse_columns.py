"""The parser in columns gives what the parser of any text gives."""

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from tests.test_parse import SAME
from trailmark.operators import parse as P, parse_columns as N
from trailmark.plans import reading_queries, views as V

ODD = [
    None, "", " \n", "\x1c\x85 ", "nothing", "only 12 things", "45.271283 5.934200 then 45.371283 5.834200", "S 45°16.277' W 005°56.052'", "N 45°16.277' O 001°56.052'", "-45.5123 170.4321", "45º16′27 5º56′3", "45 deg 16 5 deg 56",
    "45degré 16 5", "45 degrés 16.277 N 5 DEGRÉS 56.052 E", "31T 0730165 5017276", "E 5°56.052' N 45°16.277'", "12 345 6.7", "1,2,3", "5..6", "31T 730165 5017276 33N 500000 4649776", "61T 730165 5017276", "45.27 5.93", "45 16 16.6 5 56 03.1",
    "Lat 45.5 S Lon 6.1 W", "N45.27128° E005.93420°", "0 0", "45.271283,﻿5.934200", "45.271283 5.934200", "N 45°16.277' E 005°56.052'", "45|l6.277 5 5b",
]
LETTERS = "0123456789.,°'\"- NSEWO oOlI|\n*:;/é′’deg"


def mutated(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 4)):
        k, i = rng.random(), rng.randrange(len(out) + 1)
        if k < 0.4 or not out:
            out.insert(i, rng.choice(LETTERS))
        elif k < 0.7:
            out.pop(min(i, len(out) - 1))
        else:
            out[min(i, len(out) - 1)] = rng.choice(LETTERS)
    return "".join(out)


def many():
    rng = random.Random(11)
    base = [t for t in [x[1] for x in SAME] + ODD if t]
    out = [x[1] for x in SAME] + ODD + [mutated(rng, rng.choice(base)) for _ in range(900)]
    out += [mutated(rng, rng.choice(base)) + rng.choice([" ", "\n", " or ", " x "]) + mutated(rng, rng.choice(base)) for _ in range(400)]
    return out + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 30))) for _ in range(500)]


def flat(d):
    one = lambda c: None if c is None else (round(c["lat"], 9) + 0.0, round(c["lon"], 9) + 0.0, c["fmt"], round(c["score"], 9), list(c["notes"]), c["hemi"], c["seg"])
    return d["ok"], d["empty"], d["norm"], d["conf"], one(d["best"]), [one(c) for c in d["alts"]]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(enumerate(many())), "id int, text string").repartition(4)
    return df.select("text", N.plain(F.col("text")).alias("plain"), N.parse_plain("text").alias("p"), N.normalise(F.col("text")).alias("norm"), N.token_rows("text").alias("t")).collect()


def test_parses_are_equal(rows):
    assert all(r.plain for r in rows)
    for r in rows:
        assert flat(r.p.asDict(True)) == flat(P.parse(r.text)), r.text


def test_texts_and_tokens_are_equal(rows):
    for r in rows:
        if r.text is None:
            assert r.norm is None and r.t is None
            continue
        assert r.norm == P.normalise(r.text)
        run, want = 0, []
        for t in P.tokens(r.norm):
            run += t.kind == "word"
            want.append((t.kind, t.start, t.end, t.line, t.text, t.negative, t.symbol, run))
        assert [tuple(t) for t in r.t] == want, r.text


def test_texts_that_unicode_forms_change_go_to_the_other_parser(spark):
    texts = ["４５.271283 5.934200", "45.271283 5.93420½", "é 45.271283 5.934200", "45″16 5", SAME[0][1], None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select("text", N.plain(F.col("text")).alias("plain"), N.parse_plain("text").alias("p"), N.parse_any("text").alias("any")).collect():
        assert r.plain == (r.text in (None, SAME[0][1])) == (r.p is not None)
        assert flat(r.any.asDict(True)) == flat(P.parse(r.text))
    with pytest.raises(Exception, match="not plain"):
        df.select(N.parse_strict("text")).collect()


def test_plans_of_the_queries_have_no_python(spark):
    for name in ("parse_position", "parse_reliability", "parse_utm", "text_normalize", "text_tokens", "text_runs", "parse_alternatives"):
        plan = reading_queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_long_texts_take_little_time(spark):
    import time

    text = "rien de tel dans ces lignes, 12 fois sur 345\n" * 300 + SAME[0][1]
    df = spark.createDataFrame([(text,)], "text string")
    start = time.perf_counter()
    r = df.select(N.parse_strict("text").alias("p")).first()
    assert r.p.ok and r.p.best.fmt == "DMM" and time.perf_counter() - start < 30
