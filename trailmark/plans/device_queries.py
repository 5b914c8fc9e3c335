"""Queries of the stateful folds, photo sources and image kernels."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from trailmark.plans import views as V
from trailmark.streaming import state as D

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def orientations(spark, sf):
    s = V.sightings(spark, sf)
    e = F.col("seq")
    return s.select(F.col("track").alias("device"), "seq", "t", (e * 37 % 360).cast("double").alias("heading"), (e % 90 - 45).cast("double").alias("pitch"), (e % 50 == 0).alias("stop"))


def positions(spark, sf):
    """Devices that walk in steps of about eleven metres, one way or the other."""
    s = V.sightings(spark, sf)
    return s.select(F.col("track").alias("device"), "seq", "t", (F.lit(45.0) + (F.col("seq") * 37 % 11) * 0.0001).alias("lat"), F.lit(6.0).alias("lon"))


SMOOTH = f"""WITH RECURSIVE {V.SIGHTINGS}, o AS (SELECT track, seq, radians(CAST(seq * 37 % 360 AS DOUBLE)) AS h, CAST(seq % 90 - 45 AS DOUBLE) AS p, seq % 50 = 0 AS stop, row_number() OVER (PARTITION BY track ORDER BY t, seq) AS n FROM s),
r(track, n, seq, x, y, p, stop) AS (SELECT track, n, seq, CASE WHEN NOT stop THEN cos(h) END, CASE WHEN NOT stop THEN sin(h) END, CASE WHEN NOT stop THEN p END, stop FROM o WHERE n = 1
  UNION ALL SELECT o.track, o.n, o.seq, CASE WHEN o.stop THEN NULL WHEN r.x IS NULL THEN cos(o.h) ELSE r.x + 0.25::DOUBLE * (cos(o.h) - r.x) END, CASE WHEN o.stop THEN NULL WHEN r.y IS NULL THEN sin(o.h) ELSE r.y + 0.25::DOUBLE * (sin(o.h) - r.y) END,
  CASE WHEN o.stop THEN NULL WHEN r.p IS NULL THEN o.p ELSE r.p + 0.25::DOUBLE * (o.p - r.p) END, o.stop FROM r JOIN o ON o.track = r.track AND o.n = r.n + 1)
SELECT track AS device, seq, round(cos(atan2(y, x)), 6) + 0 AS c, round(sin(atan2(y, x)), 6) + 0 AS s, round(p, 6) AS pitch FROM r WHERE NOT stop"""


@query("stream_heading_smooth", SMOOTH)
def _(spark, sf):
    h = F.radians("heading")
    return D.smooth_table(orientations(spark, sf)).select("device", "seq", (F.round(F.cos(h), 6) + 0).alias("c"), (F.round(F.sin(h), 6) + 0).alias("s"), F.round("pitch", 6).alias("pitch"))


@query("stream_relief_throttle")
def _(spark, sf):
    return D.moved_enough_table(positions(spark, sf))


@query("stream_announcements")
def _(spark, sf):
    return D.announced(positions(spark, sf), 86400.0)


@query("stream_latest_position", f"WITH {V.SIGHTINGS} SELECT track AS device, arg_max(seq, (t, seq)) AS seq, arg_max(45.0::DOUBLE + (seq * 37 % 11) * 0.0001::DOUBLE, (t, seq)) AS lat, 6.0::DOUBLE AS lon FROM s GROUP BY 1")
def _(spark, sf):
    return D.latest_positions(positions(spark, sf))


@query("stream_target_distance", f"WITH {V.SIGHTINGS}, p AS (SELECT track, seq, 45.0::DOUBLE + (seq * 37 % 11) * 0.0001::DOUBLE AS lat FROM s) SELECT track AS device, seq, round({V.hav('lat', '6.0::DOUBLE', '45.1::DOUBLE', '6.1::DOUBLE')}, 3) AS d FROM p")
def _(spark, sf):
    p = positions(spark, sf)
    targets = p.select("device", F.lit(45.1).alias("lat"), F.lit(6.1).alias("lon")).distinct()
    return D.to_target(p, targets).select("device", "seq", F.round("d", 3).alias("d"))


@query("service_memo")
def _(spark, sf):
    p = positions(spark, sf)
    return D.memo(p.select(F.lit("alt").alias("kind"), (F.col("seq") % 40).cast("string").alias("key"), "seq", "t", (F.col("seq") % 3 == 0).alias("fails")), 3 * 86400.0)


@query("history_dwell", f"WITH {V.SIGHTINGS}, n AS (SELECT track AS owner, seq, ms, lead(ms) OVER (PARTITION BY track ORDER BY t, seq) AS nx FROM s) SELECT owner, seq FROM n WHERE nx IS NULL OR nx - ms >= 86400000")
def _(spark, sf):
    from trailmark.operators.track import dwelt

    return dwelt(V.sightings(spark, sf).withColumnRenamed("track", "owner"), 86400.0).select("owner", "seq")


def jpeg(text: bytes, little: bool) -> bytes:
    """A JPEG head with one Exif date."""
    o = "<" if little else ">"
    tiff = (b"II" if little else b"MM") + struct.pack(o + "HI", 42, 8) + struct.pack(o + "H", 1) + struct.pack(o + "HHII", 0x8769, 4, 1, 26) + struct.pack(o + "I", 0)
    tiff += struct.pack(o + "H", 1) + struct.pack(o + "HHII", 0x9003, 2, 20, 44) + struct.pack(o + "I", 0) + text + b"\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


@query("exif_date", "SELECT event_id AS id, 1700000000000 + event_id * 1000 AS t FROM events")
def _(spark, sf):
    from trailmark.sources.photos import exif_millis

    # the date text is put between a head and a tail that do not depend on the row
    head, tail = jpeg(b"0000:00:00 00:00:00", True).split(b"0000:00:00 00:00:00")
    e = V.read(spark, sf, "events").select(F.col("event_id").alias("id"))
    day = F.expr("TIMESTAMP_NTZ'2023-11-14 22:13:20'") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))
    content = F.concat(F.lit(head), F.encode(F.date_format(day, "yyyy:MM:dd HH:mm:ss"), "UTF-8"), F.lit(tail))
    return e.select("id", exif_millis(content).alias("t"))


@query("shot_dates", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'file' ELSE 'exif' END AS src, 'p' || CAST(event_id AS VARCHAR) || '|' || CAST(event_id % 9000 AS VARCHAR) || '|1000' AS key FROM events")
def _(spark, sf):
    from trailmark.sources.photos import new_shots

    e = V.read(spark, sf, "events").select(F.col("event_id").alias("id"))
    content = F.when(F.col("id") % 2 == 0, F.lit(b"\xff\xd8")).otherwise(F.lit(jpeg(b"2026:11:02 08:12:33", False)))
    rows = e.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), (F.col("id") % 9000).alias("size"), F.lit(1000).alias("modified"), content.alias("content"))
    return new_shots(rows).select(F.substring(F.element_at(F.split("name", "p"), 2), 1, 20).cast("long").alias("id"), "src", "key")


def images(spark, sf):
    """Synthetic photos of a bright screen with dark bars, each turned by some degrees."""

    def draw(batches):
        import numpy as np
        import pandas as pd

        from trailmark.functions.image import box_blur, rotate

        y, x = np.mgrid[0:150, 0:200]
        u, v = np.abs(x - 100), y - 75
        screen = (u < 75) & (np.abs(v) < 55)
        bars = screen & (u < 65) & (np.abs(v) < 45) & (v // 6 % 2 == 0) & ((x - 100) // 5 % 4 != 3)
        flat = box_blur(np.where(bars, 60.0, np.where(screen, 210.0, 30.0)), 1).astype(np.uint8)
        for b in batches:
            turned = [rotate(flat, int(i) % 11 - 5) for i in b["id"]]
            yield pd.DataFrame({"id": b["id"], "gray": [g.tobytes() for g in turned], "w": [g.shape[1] for g in turned], "h": [g.shape[0] for g in turned]})

    ids = V.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return ids.mapInPandas(draw, "id long, gray binary, w int, h int")


@query("image_measures")
def _(spark, sf):
    from trailmark.functions import image as I

    def measure(g):
        lo, hi = I.stretch_bounds(g)
        box = I.screen_box(g)
        deg, gain = I.skew_angle(g)
        return {"lo": lo, "hi": hi, "otsu": I.otsu(g), "sharpness": round(I.sharpness(g), 6), "deg": deg, "gain": round(gain, 6), "has_screen": box is not None}

    return I.map_images(images(spark, sf), measure, "id long, lo int, hi int, otsu int, sharpness double, deg double, gain double, has_screen boolean")


@query("image_skew", "SELECT n_nationkey AS id, true AS near FROM nation")
def _(spark, sf):
    from trailmark.functions import image as I

    angles = I.map_images(images(spark, sf), lambda g: {"deg": I.skew_angle(g)[0]}, "id long, deg double")
    return angles.select("id", (F.abs(F.col("deg") - (F.col("id") % 11 - 5)) <= 0.35).alias("near"))


@query("image_enhance")
def _(spark, sf):
    from trailmark.functions import image as I

    def sums(g):
        p = I.auto_params(g)
        return {"stretched": int(I.stretch(g, p["lo"], p["hi"]).sum()), "blurred": round(float(I.box_blur(g, 3).sum()), 3), "sharpened": int(I.unsharp(g, 1.0, 2).sum()), "enhanced": int(I.enhance(g, p).sum()), "flat": int(I.flatten(g, 8).sum())}

    return I.map_images(images(spark, sf), sums, "id long, stretched long, blurred double, sharpened long, enhanced long, flat long")


@query("image_level")
def _(spark, sf):
    from trailmark.functions import image as I

    def level(g):
        found = I.find_quad(g)
        out = I.level_step(g)
        return {"quad": found is not None, "tilt": round(found["tilt"], 3) if found else None, "cover": round(found["cover"], 3) if found else None, "step": out["step"], "deg": out["deg"], "w": out["gray"].shape[1], "h": out["gray"].shape[0]}

    return I.map_images(images(spark, sf), level, "id long, quad boolean, tilt double, cover double, step string, deg double, w int, h int")


@query("image_homography", "SELECT n_nationkey AS id, true AS back FROM nation")
def _(spark, sf):
    from trailmark.functions import image as I
    from trailmark.functions.geo import projected

    src, dst = [(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 2), (12, 1), (11, 13), (0, 9)]
    h = I.homography(src, dst)
    n = F.col("n_nationkey")
    rows = V.read(spark, sf, "nation").select(n.alias("id"), (n % 10).cast("double").alias("x"), (n % 7).cast("double").alias("y"))
    u, v = projected(h.tolist(), "x", "y")
    rows = rows.withColumns({"u": u, "v": v})
    x, y = projected(I.inverse(h).tolist(), "u", "v")
    return rows.select("id", ((F.abs(x - F.col("x")) < 1e-6) & (F.abs(y - F.col("y")) < 1e-6)).alias("back"))


@query("box_widen")
def _(spark, sf):
    from trailmark.functions.geo import widen_box

    n = F.col("n_nationkey")
    return V.read(spark, sf, "nation").select(n.alias("id"), widen_box(n / 50.0, n / 60.0, F.lit(0.2), F.lit(0.1)).alias("b")).select("id", "b.*")


@query("digit_edits")
def _(spark, sf):
    from trailmark.operators.parse import preview_edits

    t = V.texts(spark, sf)
    return preview_edits(t.select("id", "text", F.lit(9).alias("at"), (F.col("id") % 10).cast("string").alias("char"), F.lit(45.0).alias("lat"), F.lit(6.0).alias("lon")))


@query("box_turn")
def _(spark, sf):
    from trailmark.functions.geo import rotated_size, turn_box

    n = F.col("n_nationkey")
    box = F.struct((n / 50.0).alias("x"), (n / 60.0).alias("y"), F.lit(0.2).alias("w"), F.lit(0.1).alias("h"))
    size = F.struct(F.lit(640.0).alias("w"), F.lit(480.0).alias("h"))
    return V.read(spark, sf, "nation").select(n.alias("id"), turn_box(box, size, rotated_size(F.lit(640.0), F.lit(480.0), n * 3.0), n * 3.0).alias("b")).select("id", *[F.round(f"b.{c}", 9).alias(c) for c in "xywh"])


@query("put_point_rank")
def _(spark, sf):
    from trailmark.operators.track import put_points
    from trailmark.plans.track_queries import keyed

    points, q = keyed(spark, sf)
    first = q.groupBy("track").agg(F.min_by(F.struct("qid", "t", "lat", "lon", "key", "dated"), "qid").alias("q")).select("track", "q.*")
    return put_points(points, first).select("qid", "track", "how", "rank")


@query("resume_texts")
def _(spark, sf):
    from trailmark.operators.track import resume_texts

    return resume_texts(V.sightings(spark, sf))
