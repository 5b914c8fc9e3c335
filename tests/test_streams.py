import datetime as dt

from pyspark.sql import functions as F

from trailmark.plans import device_queries as Q
from trailmark.streaming import state as D
from tests.compare import DATA


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return q


def fed(spark, table, tmp_path, parts=3):
    """A stream of a table in the order of time, some files a batch."""
    rows = table.orderBy("t", "seq").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_smoothing_stream_equals_table(spark, tmp_path):
    rows = Q.orientations(spark, DATA).where("device < 40")
    run(D.smooth_headings(fed(spark, rows, tmp_path)), "smooth", tmp_path)
    key = lambda df: sorted((r.device, r.seq, round(r.heading, 6), round(r.pitch, 6)) for r in df.collect())
    assert key(spark.table("smooth")) == key(D.smooth_table(rows))


def test_throttled_stream_equals_table(spark, tmp_path):
    rows = Q.positions(spark, DATA).where("device < 40")
    run(D.moved_enough(fed(spark, rows, tmp_path)), "moved", tmp_path)
    assert sorted((r.device, r.seq) for r in spark.table("moved").collect()) == sorted((r.device, r.seq) for r in D.moved_enough_table(rows).collect())


def test_held_points_wait_for_the_answer(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    kinds = ["point", "ask", "point", "point", "answer", "point"]
    rows = spark.createDataFrame([(1, i, t + dt.timedelta(seconds=i), k) for i, k in enumerate(kinds)], "track long, seq long, t timestamp, kind string")
    run(D.held_points(fed(spark, rows.withColumn("device", F.lit(1)), tmp_path, 2)), "held", tmp_path)
    assert sorted(r.seq for r in spark.table("held").collect()) == [0, 2, 3, 5]


def test_latest_position_in_update_mode(spark, tmp_path):
    rows = Q.positions(spark, DATA).where("device < 10")
    run(D.latest_positions(fed(spark, rows, tmp_path, 1)), "latest", tmp_path, "complete")
    assert sorted(spark.table("latest").collect()) == sorted(D.latest_positions(rows).collect())
