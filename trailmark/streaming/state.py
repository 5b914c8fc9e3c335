"""Stateful streams of positions and headings, and the same folds over tables.

Streams keep a little state a device: no watermark is assumed, late rows are
handled as they come, and an optional timeout is up to the caller's query. The
table forms fold each device's rows in order, and a stream that is fed in order
gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from trailmark import constants as C
from trailmark.functions.geo import bearing_deg, haversine_m
from trailmark.operators.parse import distance_m


def _in_order(batches: Iterator[pd.DataFrame]) -> list[dict]:
    rows = pd.concat(list(batches))
    return rows.sort_values(["t", "seq"], kind="stable").to_dict("records")


def smooth_headings(stream: DataFrame) -> DataFrame:
    """Exponential smoothing of headings on the circle and of pitch (device, seq, t, heading, pitch, stop)."""

    def run(key, batches, state):
        x, y, p = state.get if state.exists else (None, None, None)
        out = []
        for r in _in_order(batches):
            if r["stop"]:
                x = y = p = None
                continue
            c, s = math.cos(math.radians(r["heading"])), math.sin(math.radians(r["heading"]))
            x, y, p = (c, s, r["pitch"]) if x is None else (x + C.SMOOTHING * (c - x), y + C.SMOOTHING * (s - y), p + C.SMOOTHING * (r["pitch"] - p))
            out.append((key[0], r["seq"], math.degrees(math.atan2(y, x)) % 360, p))
        state.update((x, y, p))
        yield pd.DataFrame(out, columns=["device", "seq", "heading", "pitch"])

    schema = "device long, seq long, heading double, pitch double"
    return stream.groupBy("device").applyInPandasWithState(run, schema, "x double, y double, p double", "append", GroupStateTimeout.NoTimeout)


def smooth_table(rows: DataFrame) -> DataFrame:
    """The fold of ``smooth_headings`` over a table: one sorted array a device."""
    item = F.struct("t", "seq", F.cos(F.radians("heading")).alias("c"), F.sin(F.radians("heading")).alias("s"), F.col("pitch").cast("double").alias("p"), "stop")
    start = "struct<x:double,y:double,p:double,out:array<struct<seq:bigint,heading:double,pitch:double>>>"

    def step(a, r):
        mixed = lambda old, new: F.when(old.isNull(), new).otherwise(old + C.SMOOTHING * (new - old))
        x, y, p = mixed(a["x"], r["c"]), mixed(a["y"], r["s"]), mixed(a["p"], r["p"])
        turned = F.struct(x.alias("x"), y.alias("y"), p.alias("p"), F.concat(a["out"], F.array(F.struct(r["seq"].alias("seq"), F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)).alias("heading"), p.alias("pitch")))).alias("out"))
        nothing = F.lit(None).cast("double")
        return F.when(r["stop"], F.struct(nothing.alias("x"), nothing.alias("y"), nothing.alias("p"), a["out"].alias("out")).cast(start)).otherwise(turned.cast(start))

    empty = F.struct(*[F.lit(None).cast("double").alias(n) for n in "xyp"], F.array().cast("array<struct<seq:bigint,heading:double,pitch:double>>").alias("out")).cast(start)
    folded = rows.groupBy("device").agg(F.array_sort(F.collect_list(item)).alias("xs")).select("device", F.aggregate("xs", empty, step)["out"].alias("out"))
    return folded.select("device", F.explode("out").alias("o")).select("device", "o.*")


def moved_enough(stream: DataFrame, metres: float = C.RELIEF_MOVE_M) -> DataFrame:
    """Positions more than ``metres`` from the last one let through (device, seq, t, lat, lon)."""

    def run(key, batches, state):
        last = state.get if state.exists else None
        out = []
        for r in _in_order(batches):
            if last is None or distance_m(last, (r["lat"], r["lon"])) > metres:
                last = (r["lat"], r["lon"])
                out.append((key[0], r["seq"], *last))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["device", "seq", "lat", "lon"])

    return stream.groupBy("device").applyInPandasWithState(run, "device long, seq long, lat double, lon double", "lat double, lon double", "append", GroupStateTimeout.NoTimeout)


def moved_enough_table(rows: DataFrame, metres: float = C.RELIEF_MOVE_M) -> DataFrame:
    item = F.struct("t", "seq", "lat", "lon")
    kind = "array<struct<seq:bigint,lat:double,lon:double>>"

    def step(a, r):
        last = F.try_element_at(a, F.lit(-1))
        far = last.isNull() | (haversine_m(last["lat"], last["lon"], r["lat"], r["lon"]) > metres)
        return F.when(far, F.concat(a, F.array(F.struct(r["seq"].alias("seq"), r["lat"].alias("lat"), r["lon"].alias("lon"))))).otherwise(a)

    folded = rows.groupBy("device").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return folded.select("device", F.explode(F.aggregate("xs", F.array().cast(kind), step)).alias("o")).select("device", "o.*")


def throttled(stream: DataFrame, seconds: float = 3.0) -> DataFrame:
    """At most one row a device in ``seconds`` (device, seq, t)."""

    def run(key, batches, state):
        last = state.get[0] if state.exists else None
        out = []
        for r in _in_order(batches):
            ms = int(pd.Timestamp(r["t"]).value // 1_000_000)
            if last is None or ms - last >= seconds * 1000:
                last = ms
                out.append((key[0], r["seq"]))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["device", "seq"])

    return stream.groupBy("device").applyInPandasWithState(run, "device long, seq long", "ms long", "append", GroupStateTimeout.NoTimeout)


def held_points(stream: DataFrame) -> DataFrame:
    """Points wait until their track's question is answered (track, seq, t, kind: point, ask or answer)."""

    def run(key, batches, state):
        asked, held = state.get if state.exists else (False, [])
        held, out = list(held), []
        for r in _in_order(batches):
            if r["kind"] == "ask":
                asked = True
            elif r["kind"] == "answer":
                out += held
                asked, held = False, []
            elif asked:
                held.append(int(r["seq"]))
            else:
                out.append(int(r["seq"]))
        state.update((asked, held))
        yield pd.DataFrame([(key[0], s) for s in out], columns=["track", "seq"])

    return stream.groupBy("track").applyInPandasWithState(run, "track long, seq long", "asked boolean, held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def latest_positions(rows: DataFrame) -> DataFrame:
    """The last position of each device, for tables and (in update mode) for streams."""
    return rows.groupBy("device").agg(F.max_by(F.struct("seq", "lat", "lon"), F.struct("t", "seq")).alias("p")).select("device", "p.*")


def to_target(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """Distance and bearing of each position to its device's target: a stream-static join on the device."""
    met = positions.join(targets.select("device", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), "device")
    return met.select("device", "seq", haversine_m("lat", "lon", "t_lat", "t_lon").alias("d"), bearing_deg("lat", "lon", "t_lat", "t_lon").alias("b"))


def announced(rows: DataFrame, seconds: float = 3.0) -> DataFrame:
    """``throttled`` over a table."""
    item = F.struct(F.unix_millis("t").alias("ms"), "seq")

    def step(a, r):
        last = F.try_element_at(a, F.lit(-1))
        return F.when(last.isNull() | (r["ms"] - last["ms"] >= int(seconds * 1000)), F.concat(a, F.array(r))).otherwise(a)

    folded = rows.groupBy("device").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return folded.select("device", F.explode(F.aggregate("xs", F.array().cast("array<struct<ms:bigint,seq:bigint>>"), step)).alias("o")).select("device", "o.seq")


def memo(requests: DataFrame, ttl_s: float = 30.0) -> DataFrame:
    """Which requests reach a service: the first of a key, and after a failure the next beyond ``ttl_s``.

    requests: kind, key, seq, t, fails. A success is kept for good.
    """
    item = F.struct(F.unix_millis("t").alias("ms"), "seq", "fails")

    def step(a, r):
        last = F.try_element_at(a, F.lit(-1))
        again = last.isNull() | (last["fails"] & (r["ms"] - last["ms"] >= int(ttl_s * 1000)))
        return F.when(again, F.concat(a, F.array(r))).otherwise(a)

    folded = requests.groupBy("kind", "key").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return folded.select("kind", "key", F.explode(F.aggregate("xs", F.array().cast("array<struct<ms:bigint,seq:bigint,fails:boolean>>"), step)).alias("o")).select("kind", "key", "o.seq", "o.fails")
