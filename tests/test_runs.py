"""Tables of runs, the photo queue, heads of files."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from trailmark.plans.device_queries import jpeg
from trailmark.sources import heads as H, photos as P, runs as R

T0 = dt.datetime(2026, 1, 1)
POINT = "track long, seq long, t timestamp, lat double, lon double, label string"


def points(spark, rows):
    return spark.createDataFrame([(1, seq, T0 + dt.timedelta(hours=h), 45.0, 5.0, label) for seq, h, label in rows], POINT)


def test_late_rows_are_in_place_runs_are_bounded_and_batches_count_once(spark, tmp_path):
    table = R.track_table(spark, str(tmp_path / "track"), most=3)
    for n in range(12):
        assert table.append(points(spark, [(n, 100 - n, f"b{n}")]), n)
    assert not table.append(points(spark, [(0, 0, "again")]), 11)
    assert table.append(points(spark, [(3, 50, "moved")]), 12)
    got = R.load_points(table).orderBy("place").collect()
    assert [r.seq for r in got] == [3, *range(11, 3, -1), 2, 1, 0] and got[0].label == "moved"
    assert len(table.manifest()["runs"]) <= 3 and len(list((tmp_path / "track" / "runs").iterdir())) <= 2 * 4
    assert len([p for p in (tmp_path / "track" / "manifest").iterdir() if p.name.endswith(".json") and not p.name.startswith(".")]) <= 2


def test_a_crash_before_the_commit_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = R.track_table(spark, str(tmp_path / "track"))
    table.append(points(spark, [(0, 0, "a")]), 0)
    with monkeypatch.context() as m:
        m.setattr(R.RunTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.append(points(spark, [(1, 1, "b")]), 1)
    assert table.load().count() == 1
    assert table.append(points(spark, [(1, 1, "b")]), 1) and table.load().count() == 2


def test_equal_dates_keep_the_order_of_their_coming(spark, tmp_path):
    table = R.track_table(spark, str(tmp_path / "track"))
    table.append(points(spark, [(9, 0, "first")]), 0)
    table.append(points(spark, [(1, 0, "second")]), 1)
    assert [r.label for r in R.load_points(table).orderBy("place").collect()] == ["first", "second"]
    assert R.load_points(R.track_table(spark, str(tmp_path / "none"))).count() == 0


EVENT = "seq long, kind string, id string, t timestamp"


def test_queue_reads_additions_once_and_a_stop_leaves_photos_waiting(spark, tmp_path):
    read = []

    def reader(claimed):
        ids = sorted(r.id for r in claimed.collect())
        read.append(ids)
        return claimed.select("id", F.when(F.col("id") == "b", "fail").otherwise("ok").alias("st"))

    q = R.PhotoQueue(spark, str(tmp_path / "queue"), reader)
    event = lambda *rows: spark.createDataFrame([(s, k, i, T0) for s, k, i in rows], EVENT)
    q.round(event((0, "add", "a"), (1, "add", "b")), 0)
    q.round(event((2, "add", "c"), (3, "add", "a")), 1)
    q.round(event((4, "add", "d"), (5, "stop", None)), 2)
    q.round(event((6, "add", "e")), 3)
    assert {r.id: r.st for r in q.states().collect()} == {"a": "ok", "b": "fail", "c": "ok", "d": "wait", "e": "wait"}
    q.round(event((7, "start", None)), 4)
    q.round(event((7, "start", None)), 4)  # the same batch again
    assert read == [["a", "b"], ["c"], [], [], ["b", "d", "e"]]
    assert {r.id: r.st for r in q.states().collect()} == {"a": "ok", "b": "fail", "c": "ok", "d": "ok", "e": "ok"}


def test_queue_repeats_a_round_that_was_lost_with_the_same_claims(spark, tmp_path):
    tries = []

    def reader(claimed):
        tries.append(sorted(r.id for r in claimed.collect()))
        if len(tries) == 1:
            raise OSError("engine lost")
        return claimed.select("id", F.lit("ok").alias("st"))

    q = R.PhotoQueue(spark, str(tmp_path / "queue"), reader)
    events = spark.createDataFrame([(0, "add", "a", T0)], EVENT)
    with pytest.raises(OSError):
        q.round(events, 0)
    q.round(events, 0)
    assert tries == [["a"], ["a"]] and q.states().first().st == "ok"


def test_queue_follows_a_stream(spark, tmp_path):
    q = R.PhotoQueue(spark, str(tmp_path / "queue"), lambda claimed: claimed.select("id", F.lit("ok").alias("st")))
    for i in range(2):
        spark.createDataFrame([(i, "add", f"p{i}", T0)], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        run = q.follow(stream, str(tmp_path / "at"))
        run.awaitTermination(180)
        assert run.exception() is None
    assert sorted((r.id, r.st) for r in q.states().collect()) == [("p0", "ok"), ("p1", "ok")]


def oriented(turn: int) -> bytes:
    tiff = b"MM" + struct.pack(">HI", 42, 8) + struct.pack(">H", 1) + struct.pack(">HHIHH", 0x0112, 3, 1, turn, 0) + struct.pack(">I", 0)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


def test_only_heads_of_files_are_read(spark, tmp_path):
    big = jpeg(b"2026:11:02 08:12:33", True) + b"\0" * 3_000_000
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jpg").write_bytes(big)
    (tmp_path / "sub" / "b.JPG").write_bytes(oriented(6))
    (tmp_path / "c.txt").write_bytes(b"no photo")
    rows = {r.name: r for r in H.read_heads(spark, str(tmp_path)).select("name", "size", F.length("content").alias("read"), P.exif_orientation("content").alias("turn")).collect()}
    assert {n: (r.size, r.read, r.turn) for n, r in rows.items()} == {"a.jpg": (len(big), 131_072, 1), "b.JPG": (len(oriented(6)), len(oriented(6)), 6), "c.txt": (8, 8, 1)}
    few = H.read_heads(spark, f"file://{tmp_path}", bytes=100, files=1, suffix=".jpg")
    assert sorted((r.name, len(r.content)) for r in few.collect()) == [("a.jpg", 100), ("b.JPG", len(oriented(6)))] and few.rdd.getNumPartitions() == 2
    shots = P.by_date(P.read_photos(spark, str(tmp_path))).collect()
    assert {s.name: s.src for s in shots} == {"a.jpg": "exif", "b.JPG": "file", "c.txt": "file"} and [s.t for s in shots] == sorted(s.t for s in shots)


def test_reader_asks_for_no_more_than_a_head(tmp_path, monkeypatch):
    from pyarrow import fs

    (tmp_path / "a.jpg").write_bytes(b"x" * 500_000)
    asked = []

    class File:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

        def read_at(self, n, at):
            asked.append((at, n))
            return b"x" * n

    reader = H.HeadsReader({"path": str(tmp_path)})
    parts = reader.partitions()
    system = type("S", (), {"open_input_file": lambda self, path: File()})()
    monkeypatch.setattr(reader, "_system", lambda: (system, ""))
    assert [len(r[4]) for p in parts for r in reader.read(p)] == [131_072] and asked == [(0, 131_072)] and fs


def test_tracks_are_saved_and_exported_and_read_again(spark, tmp_path):
    from trailmark.plans import views as V
    from trailmark.sources import tracks as S
    from tests.compare import DATA

    points = V.sightings(spark, DATA).where("track < 20")
    S.save_track(points, str(tmp_path / "saved"))
    assert S.load_track(spark, str(tmp_path / "saved")).count() == points.count() > 0
    S.write_gpx(points, str(tmp_path / "gpx"), files=3)
    assert len(list((tmp_path / "gpx").glob("part-*"))) <= 3
    back = S.read_gpx(spark, str(tmp_path / "gpx"))
    key = lambda df, c: sorted((r[0], round(r.lat, 6), round(r.lon, 6)) for r in df.select(c, "lat", "lon").collect())
    assert key(back.withColumn("id", F.col("id").cast("long")), "id") == key(points, "track")
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.gpx").write_text(spark.read.parquet(str(tmp_path / "gpx")).first().gpx)
    assert S.import_files(S.read_texts(spark, str(tmp_path / "texts"))).count() > 0
