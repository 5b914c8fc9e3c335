import json

import numpy as np

from trailmark.functions import image as I
from trailmark.sources import stored as S


def lines(path, rows):
    path.mkdir()
    (path / "a.json").write_text("\n".join(map(json.dumps, rows)))


def test_answers_of_a_folder(spark, tmp_path):
    lines(tmp_path / "in", [{"key": "a", "status": 200, "body": '{"z": 3}'}, {"key": "b", "status": 404, "body": '{"z": 3}'}, {"key": "c", "status": 204, "body": "oops"}, {"key": "d", "status": 200, "body": None}])
    got = {r.key: (r.value.z if r.value else None, r.failed) for r in S.read_answers(spark, str(tmp_path / "in"), "z double").collect()}
    assert got == {"a": (3.0, False), "b": (None, True), "c": (None, True), "d": (None, True)}


def test_streams_leave_out_old_and_invalid_rows(spark, tmp_path):
    at = "2024-01-01T00:00:00Z"
    lines(tmp_path / "p", [{"device": 1, "seq": i, "t": at, "lat": lat, "lon": 5.0, "age_ms": age} for i, (lat, age) in enumerate([(45.0, 0), (45.0, 6000), (95.0, 0), (46.0, None)])])
    lines(tmp_path / "h", [{"device": 1, "seq": 0, "t": at, "heading": 3.0, "stop": False}, {"device": 1, "seq": 1, "t": at, "stop": False}, {"device": 1, "seq": 2, "t": at, "stop": True}])
    out = []
    for name, stream in (("p", S.position_stream(spark, str(tmp_path / "p"))), ("h", S.heading_stream(spark, str(tmp_path / "h")))):
        q = stream.writeStream.format("memory").queryName(f"stored_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(sorted(r.seq for r in spark.table(f"stored_{name}").collect()))
    assert out == [[0, 3], [0, 2]]


def test_late_points_are_kept_and_come_in_order(spark, tmp_path):
    lines(tmp_path / "in", [{"device": 1, "seq": 2, "t": "2024-01-02T00:00:00Z", "lat": 45.0, "lon": 5.0}])
    for late in (None, {"device": 1, "seq": 1, "t": "2024-01-01T00:00:00Z", "lat": 45.0, "lon": 5.0}):
        if late:
            (tmp_path / "in" / "b.json").write_text(json.dumps(late))
        S.keep_late_points(S.position_stream(spark, str(tmp_path / "in")), str(tmp_path / "track"), str(tmp_path / "state")).awaitTermination()
    from trailmark.sources.runs import load_points, track_table

    points = load_points(track_table(spark, str(tmp_path / "track")))
    assert [(r.seq, r.place) for r in points.orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_views_and_display_of_a_zone():
    g = np.full((120, 160), 20, np.uint8)
    g[30:90, 40:120] = 220
    assert [(v["name"], v["flat"]) for v in I.zone_views(g)] == [("whole", False), ("whole", True), ("screen", False), ("screen", True)]
    x, y, w, h = I.zone_views(g)[2]["box"]
    assert abs(x - 0.235) < 0.02 and abs(w - 0.53) < 0.02 and abs(y - 0.235) < 0.02 and abs(h - 0.53) < 0.02
    assert len(I.zone_views(np.full((120, 160), 7, np.uint8))) == 2
    part = I.cropped(g, (0.25, 0.25, 0.5, 0.5), 40)
    assert part.shape == (30, 40) and (part == 220).all()
    shown = I.zone_display(g, (0.25, 0.25, 0.5, 0.5), 80)
    assert shown.shape == (60, 80) and shown.min() >= 240  # 255 / (1 + exp(-92 / 30)) is 244
    assert I.display_tone([0, 128, 255]).tolist() == [4, 128, 251]
