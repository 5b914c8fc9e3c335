"""The elevation profile of a track as rows to draw: ticks, the terrain's outline, ends and pins.

Everything is an aggregate of the samples: the outline holds the lowest and the highest
altitude of each pixel column, so its size is the drawing's, whatever the track's. Pins
that lie close together are one; there are as many as fit the width, and they are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark import constants as C
from trailmark.functions.geo import js_round, nice_step
from trailmark.functions.text import distance_text
from trailmark.operators.spatial import profile_groups

# Fixed values of the drawing: its size and margins, the least span of altitudes, and the space that a pin's label takes.
WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 600, 200, 60, 26, 22, 26
LEAST_SPAN, LABEL_GAP, CHAR_GAP, RANGE_FROM = 20.0, 30, 4, 5.0


def tenth(v: Column) -> Column:
    return js_round(v * 10) / 10


def grouped(v: Column) -> Column:
    """A rounded number with a narrow space between thousands."""
    n = js_round(v).cast("long")
    text = F.regexp_replace(F.abs(n).cast("string"), r"(?<=\d)(?=(\d{3})+$)", "\u202f")
    return F.concat(F.when(n < 0, "-").otherwise(""), text)


def scales(samples: DataFrame) -> DataFrame:
    """track, y0, y1, step, dmax of tracks with two known altitudes or more (samples: track, i, d, z, k)."""
    rows = samples.groupBy("track").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("z").alias("n"), F.max_by("d", "i").alias("dmax")).where("n >= 2")
    flat = F.col("high") - F.col("low") < LEAST_SPAN
    mid = (F.col("high") + F.col("low")) / 2
    rows = rows.withColumns({"low": F.when(flat, mid - LEAST_SPAN / 2).otherwise(F.col("low")), "high": F.when(flat, mid + LEAST_SPAN / 2).otherwise(F.col("high"))})
    rows = rows.withColumn("step", nice_step(F.col("high") - F.col("low")))
    whole = lambda f, c: f(F.col(c) / F.col("step")).cast("double") * F.col("step")
    return rows.select("track", whole(F.floor, "low").alias("y0"), whole(F.ceil, "high").alias("y1"), "step", F.when(F.col("dmax") == 0, 1.0).otherwise(F.col("dmax")).alias("dmax"))


def x_of(d: Column) -> Column:
    return F.lit(float(LEFT)) + d / F.col("dmax") * (WIDTH - LEFT - RIGHT)


def y_of(z: Column) -> Column:
    return F.lit(float(TOP)) + (1 - (z - F.col("y0")) / (F.col("y1") - F.col("y0"))) * (HEIGHT - TOP - BOTTOM)


def profile_rows(samples: DataFrame) -> DataFrame:
    """track, kind, ord, x, y, y2, label, text, shown.

    samples: track, i (order), d (metres), z (null where unknown), k (number of the track's point, -1 between points).
    ``tick``: a line at y with its altitude. ``line``: the terrain in pixel column ord, from y (highest) to y2 (lowest).
    ``end``: 0 and the length. ``pin``: the points at x, y with their numbers, and their altitude, shown where it fits.
    A track with fewer than two known altitudes has no rows.
    """
    scale = scales(samples)
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, ord_, x, y, y2, label, text, shown: [F.lit(kind).alias("kind"), ord_.cast("int").alias("ord"), x.cast("double").alias("x"), y.cast("double").alias("y"), y2.cast("double").alias("y2"), label.cast("string").alias("label"), text.cast("string").alias("text"), shown.cast("boolean").alias("shown")]
    steps = F.sequence(F.lit(0), F.floor((F.col("y1") + 0.1 - F.col("y0")) / F.col("step")).cast("int"))
    ticks = scale.select("*", F.explode(steps).alias("n")).withColumn("z", F.col("y0") + F.col("n") * F.col("step"))
    ticks = ticks.select("track", *row("tick", F.col("n"), F.lit(LEFT), tenth(y_of(F.col("z"))), none("double"), grouped(F.col("z")), none("string"), F.lit(True)))
    placed = samples.where("z is not null").join(scale, "track").withColumns({"px": x_of(F.col("d")), "py": y_of(F.col("z"))})
    line = placed.groupBy("track", F.floor("px").alias("column")).agg(F.min("py").alias("high"), F.max("py").alias("low"))
    line = line.select("track", *row("line", F.col("column"), F.col("column"), tenth(F.col("high")), tenth(F.col("low")), none("string"), none("string"), F.lit(True)))
    ends = scale.select("track", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit(LEFT).alias("x"), F.lit("0").alias("t")), F.struct(F.lit(1).alias("n"), F.lit(WIDTH - RIGHT).alias("x"), distance_text(F.col("dmax")).alias("t")))).alias("e"))
    ends = ends.select("track", *row("end", F.col("e.n"), F.col("e.x"), F.lit(HEIGHT - 6), none("double"), F.col("e.t"), none("string"), F.lit(True)))
    out = ticks
    for part in (line, ends, pins(placed.where("k >= 0"), row)):
        out = out.unionByName(part)
    return out


def pins(points: DataFrame, row) -> DataFrame:
    """The pins of placed points: groups of neighbours, their label and whether their altitude fits beside the one before."""
    groups = profile_groups(points.select("track", "i", F.col("px").alias("x")), C.PROFILE_PIN_PX)
    members = groups.select("track", "grp", F.explode("ids").alias("i")).join(points.select("track", "i", "px", "py", "z", "k"), ["track", "i"])
    g = members.groupBy("track", "grp").agg(F.min_by(F.struct("px", "py", "k"), "i").alias("a"), F.max_by("k", "i").alias("last"), F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    label = F.when(F.col("n") == 1, (F.col("a.k") + 1).cast("string")).otherwise(F.concat((F.col("a.k") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string")))
    g = g.withColumn("label", label).withColumn("w", F.greatest(F.lit(18), 8 + F.length("label") * 8).cast("double"))
    x = tenth(F.least(F.greatest(F.col("a.px"), LEFT + F.col("w") / 2 - 9), WIDTH - RIGHT + 9 - F.col("w") / 2))
    text = F.concat(grouped(F.col("lo")), F.when(F.col("hi") - F.col("lo") >= RANGE_FROM, F.concat(F.lit("-"), grouped(F.col("hi")))).otherwise(""))
    g = g.select("track", "grp", x.alias("x"), tenth(F.col("a.py")).alias("y"), "label", text.alias("text"))
    # the last altitude shown decides on the next: a fold over as many pins as a drawing holds
    kind = "struct<at:double,out:array<struct<grp:int,x:double,y:double,label:string,text:string,shown:boolean>>>"
    item = F.struct(F.col("grp").cast("int").alias("grp"), "x", "y", "label", "text")

    def step(s, p):
        shown = p["x"] - s["at"] >= LABEL_GAP + F.length(p["text"]) * CHAR_GAP
        return F.struct(F.when(shown, p["x"]).otherwise(s["at"]).alias("at"), F.concat(s["out"], F.array(F.struct(p["grp"].alias("grp"), p["x"].alias("x"), p["y"].alias("y"), p["label"].alias("label"), p["text"].alias("text"), shown.alias("shown")))).alias("out")).cast(kind)

    folded = g.groupBy("track").agg(F.array_sort(F.collect_list(item)).alias("gs"))
    start = F.struct(F.lit(-99.0).alias("at"), F.array().alias("out")).cast(kind)
    p = folded.select("track", F.explode(F.aggregate("gs", start, step)["out"]).alias("p"))
    return p.select("track", *row("pin", F.col("p.grp"), F.col("p.x"), F.col("p.y"), F.lit(None), F.col("p.label"), F.col("p.text"), F.col("p.shown")))


def numbered(points: DataFrame) -> DataFrame:
    """``k`` of samples that are points of the track (``point``): their number from 0; -1 for those between."""
    w = Window.partitionBy("track").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("k", F.when(F.col("point"), F.count_if("point").over(w) - 1).otherwise(-1)).drop("point")
