import pytest

from trailmark.operators.parse import distance_m, normalise, parse

LAT, LON = 45.271283, 5.934200
SAME = [
    ("DMM", "N 45°16.277'\nE 005°56.052'", "DMM", True),
    ("DMM suffix", "45°16.277'N 5°56.052'E", "DMM", True),
    ("DMS suffix", "45°16'16.6\"N 5°56'03.1\"E", "DMS", True),
    ("UTM", "31T 0730165 5017276", "UTM 31T", True),
    ("DD", "45.271283, 5.934200", "DD", True),
    ("decimal comma", "45,271283 5,934200", "DD", True),
    ("map link", "https://www.google.com/maps?q=45.271283,5.934200", "DD", True),
    ("geo link", "geo:45.271283,5.934200", "DD", True),
    ("NMEA", "N 4516.277 E 00556.052", "NMEA", False),
    ("swapped", "5.934200 45.271283", "DD", False),
    ("words", "Latitude : 45.271283 Longitude : 5.934200", "DD", True),
    ("letters for digits", "N 45°16.277' E OO5°56.O52'", "DMM", True),
]


@pytest.mark.parametrize("name,text,fmt,reliable", SAME, ids=[x[0] for x in SAME])
def test_one_position_in_many_formats(name, text, fmt, reliable):
    p = parse(text)
    assert p["ok"] and p["best"]["fmt"] == fmt
    assert distance_m((p["best"]["lat"], p["best"]["lon"]), (LAT, LON)) < 3
    assert (p["conf"] == "ok") == reliable


def test_signs_and_hemispheres():
    south = parse("S 45°16.277' W 005°56.052'")["best"]
    assert south["lat"] < 0 and south["lon"] < 0
    west = parse("N 45°16.277' O 001°56.052'")
    assert west["best"]["lon"] < 0 and "west" in west["best"]["notes"] and west["conf"] == "check"
    assert parse("-45.5123 170.4321")["best"]["lat"] == -45.5123


def test_texts_without_position():
    assert parse(" \n")["empty"] and parse(None)["empty"]
    assert not parse("no coordinates here")["ok"] and not parse("only 12 things")["ok"]


def test_two_positions_give_alternatives():
    p = parse("45.271283 5.934200 then 45.371283 5.834200")
    assert p["ok"] and len(p["alts"]) == 1 and p["conf"] == "check"


def test_long_text_is_linear():
    p = parse("rien de tel dans ces lignes, 12 fois sur 345\n" * 300 + "N 45°16.277' E 005°56.052'")
    assert p["ok"] and distance_m((p["best"]["lat"], p["best"]["lon"]), (LAT, LON)) < 3


def test_normalisation():
    assert normalise("45º16′27″") == "45°16'27\""
    assert normalise("45 deg 16") == "45 ° 16"
    assert normalise("45degré 16").startswith("45degr")


def test_rows_equal_single_texts(spark):
    from trailmark.operators.parse import parse_position

    texts = [x[1] for x in SAME] + [None, "", "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts * 20)), "id int, text string").repartition(7).select("id", "text", parse_position("text").alias("p")).collect()
    for r in rows:
        one = parse(r.text)
        assert r.p.ok == one["ok"] and (not r.p.ok or (r.p.best.lat, r.p.best.fmt, r.p.conf) == (one["best"]["lat"], one["best"]["fmt"], one["conf"]))


@pytest.mark.parametrize("text", ["45 DEGR\u00c9S 16.277' N 5 DEGR\u00c9S 56.052' E", "N 45\u00b016.277'\u2028E 005\u00b056.052'", "45.271283,\ufeff5.934200", "45.271283\u16805.934200"])
def test_accented_capitals_and_unicode_blanks(text):
    p = parse(text)
    assert p["ok"] and distance_m((p["best"]["lat"], p["best"]["lon"]), (LAT, LON)) < 3


def test_long_text_takes_under_two_seconds():
    import time

    text = "Une ligne de texte sans position, ou presque.\n" * 300 + "N 45\u00b016.277' E 005\u00b056.052'"
    start = time.perf_counter()
    assert parse(text)["ok"] and time.perf_counter() - start < 2


def test_batches_give_what_single_texts_give():
    import random
    import re
    import time

    import pyarrow as pa

    from tests.test_parse_columns import many
    from trailmark.operators.parse import parse
    from trailmark.operators.parse_batch import parse_array, parse_distinct

    rng = random.Random(4)
    texts = [t for t in many() if t is not None]
    digits = lambda t: re.sub("[0-9]", lambda m: rng.choice("0012345" + m[0] * 6), t)
    texts = [*dict.fromkeys([*texts, *(digits(t) for t in texts for _ in range(5))])]
    for t, got in zip(texts, parse_array(pa.array(texts)).to_pylist()):
        assert got == parse(t), t
    assert parse_array(pa.array([None, "1 2", None])).to_pylist() == [parse(t) for t in (None, "1 2", None)]
    one = [f"N 44°{i // 1000 % 60:02}.{i % 1000:03}' E 005°{i * 7 % 60:02}.{i * 13 % 1000:03}'" for i in range(20000)]
    start = time.perf_counter()
    parse_distinct(one)
    side_by_side, start = time.perf_counter() - start, time.perf_counter()
    for t in one[:2000]:
        parse.__wrapped__(t)
    assert side_by_side / 20000 < (time.perf_counter() - start) / 2000 / 4
