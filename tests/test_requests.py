"""State machines of requests: each stream gives its table's rows, also across a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from tests.test_streams import fed
from trailmark.plans import device_queries as Q, request_queries as RQ
from trailmark.streaming import requests as R, state as D

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drained(stream, tmp_path, name):
    """Run a stream over what there is, with a file sink and a checkpoint that a later run continues from."""
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-at")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def test_relief_answers_to_superseded_requests_are_stale(spark):
    show = lambda s, sig, online=True: (1, s, at(s), "show", sig, online, None, None)
    answer = lambda s, req, ok: (1, s, at(s), "answer", None, None, req, ok)
    rows = [show(0, "a"), show(1, "a"), show(2, "b"), answer(3, 0, True), show(4, "a"), answer(5, 0, True), answer(6, 4, False), show(7, "a"), answer(8, 7, True), answer(9, 7, False), show(10, "a"), show(11, "c", False), show(12, "c"), answer(13, 11, True)]
    got = R.relief_requests_table(spark.createDataFrame(rows, "owner long, seq long, t timestamp, kind string, sig string, online boolean, req long, ok boolean"))
    assert [r.how for r in sorted(got.collect(), key=lambda r: r.seq)] == ["ask", "kept", "ask", "stale", "ask", "stale", "failed", "ask", "known", "stale", "kept", "unknown", "kept", "stale"]


def test_relief_stream_equals_table(spark, tmp_path):
    rows = RQ.relief_events(spark, DATA).where("owner < 30")
    got = drained(R.relief_requests(fed(spark, rows, tmp_path)), tmp_path, "relief")
    assert sorted(map(str, got.collect())) == sorted(map(str, R.relief_requests_table(rows).collect())) and got.count() > 0


@pytest.mark.parametrize("watermark", [False, True])
def test_memo_stream_equals_table_across_a_restart(spark, tmp_path, watermark):
    p = Q.positions(spark, DATA).where("device < 60")
    rows = p.select(F.lit("alt").alias("kind"), (F.col("seq") % 11).cast("string").alias("key"), "seq", "t", (F.col("seq") % 3 == 0).alias("fails"))
    whole = rows.orderBy("t", "seq").collect()
    folder, size = tmp_path / "in", len(whole) // 2
    folder.mkdir()
    source = spark.readStream.schema(rows.schema).parquet(str(folder))
    source = source.withWatermark("t", "0 seconds") if watermark else source
    for part in (whole[:size], whole[size:]):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(str(folder))
        got = drained(R.memo_stream(source, 3 * 86400.0), tmp_path, "memo")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.memo(rows, 3 * 86400.0).select("kind", "key", "seq", "fails").collect()))


def test_points_are_recorded_by_timer_flush_or_not(spark, tmp_path):
    events = [(1, 0, 0.0, "point"), (1, 1, 1.0, "point"), (1, 2, 1.2, "flush"), (1, 3, 2.0, "point"), (1, 4, 3.0, "cancel"), (1, 5, 4.0, "point"), (1, 6, 9.0, "point"), (2, 7, 9.5, "point"), (1, 8, 9.6, "flush"), (2, 9, 11.0, "cancel")]
    rows = spark.createDataFrame([(o, s, at(t), k) for o, s, t, k in events], "owner long, seq long, t timestamp, kind string")
    ms = lambda t: int((T0 + dt.timedelta(seconds=t)).replace(tzinfo=dt.UTC).timestamp() * 1000)
    want = [(1, 1, ms(1.2)), (1, 5, ms(5.5)), (1, 6, ms(9.6)), (2, 7, ms(11.0))]
    off = R.recorded(rows).first().ms - want[0][2]  # the session's zone reads naive times
    assert sorted((r.owner, r.seq, r.ms - off) for r in R.recorded(rows).collect()) == want
    # a later event moves the watermark on, and timers of quiet owners fire
    late = spark.createDataFrame([(3, 99, at(600.0), "cancel")], rows.schema)
    stream = fed(spark, rows.unionByName(late), tmp_path, 4).withWatermark("t", "0 seconds")
    got = drained(R.recorded_stream(stream), tmp_path, "recorded")
    assert sorted((r.owner, r.seq, r.ms - off) for r in got.collect()) == want


def test_timer_fires_for_an_owner_without_further_events(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, at(0.0), "point"), (2, 1, at(1.0), "cancel"), (2, 2, at(60.0), "cancel"), (2, 3, at(120.0), "cancel")], "owner long, seq long, t timestamp, kind string")
    got = drained(R.recorded_stream(fed(spark, rows, tmp_path, 4).withWatermark("t", "0 seconds")), tmp_path, "quiet")
    assert [(r.owner, r.seq) for r in got.collect()] == [(1, 0)]


def test_history_keeps_the_last_different_positions(spark):
    rows = spark.createDataFrame([(1, i, i, f"k{i % 4}", "x" * 500) for i in range(9)], "owner long, seq long, ms long, k string, src string")
    got = sorted(R.history_of(rows, 3).collect(), key=lambda r: r.place)
    assert [(r.k, r.ms, len(r.src)) for r in got] == [("k0", 8, 400), ("k3", 7, 400), ("k2", 6, 400)]
