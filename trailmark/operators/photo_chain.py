"""A photo from its recognised lines to a state, reading no more than is needed.

The recogniser is a service outside: functions that take a DataFrame of requests and
return a DataFrame of what was read. Reading is the dear step, so the chain is an
escalation over tables: each round asks only for photos that the rounds before left
open (an anti-join), and the number of rounds is bounded by the views of a photo and
by the passes over a box. What a round has read is cut off as a table.

``gone``, where given, names photos that were changed or given up meanwhile; it is
asked again before each round, and such photos have no result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trailmark import constants as C
from trailmark.functions.geo import in_region, js_round, rotated_size, turn_box, widen_box
from trailmark.operators import vote
from trailmark.operators.parse import parse_position
from trailmark.operators.trust import confidence, shot_state
from trailmark.stages import cut

Reader = Callable[[DataFrame], DataFrame]
VIEWS = ["whole", "whole, flat", "screen", "screen, flat"]
ALTS = "array<struct<lat:double,lon:double>>"
WORDS = "array<struct<text:string,confidence:double>>"


def clean(p: Column) -> Column:
    """Read without a warning or another reading, inside the region."""
    return F.coalesce((F.size(p["best"]["notes"]) == 0) & (F.size(p["alts"]) == 0) & in_region(p["best"]["lat"], p["best"]["lon"]), F.lit(False))


def zone_rank(p: Column) -> Column:
    return p["best"]["score"] - 0.5 * F.size(p["best"]["notes"]) - 0.5 * F.size(p["alts"])


def weighted(words: Column) -> Column:
    """Mean confidence of words, weighted by their length; null without any that has one."""
    known = F.filter(words, lambda w: w["confidence"].isNotNull())
    sums = F.aggregate(known, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("n")), lambda a, w: F.struct((a["c"] + w["confidence"] * vote.word_weight(F.coalesce(w["text"], F.lit("")))).alias("c"), (a["n"] + vote.word_weight(F.coalesce(w["text"], F.lit("")))).alias("n")))
    return F.when(F.size(known) > 0, sums["c"] / sums["n"])


def coordinate_zones(lines: DataFrame, *keys: str, most: int = 3) -> DataFrame:
    """The window of up to ``most`` lines of each page that reads best, and the box of its coordinate words.

    lines: keys, line, text, confidence, x0, y0, x1, y1, words (array of text, confidence, x0, y0, x1, y1).
    Returns keys, text, p (the parse), box (x0, y0, x1, y1), conf. A page without a position has no row.
    """
    kept = lines.where((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & F.col("x0").isNotNull())
    word = F.struct(F.trim("text").alias("text"), F.col("confidence").cast("double").alias("confidence"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    words = F.filter(F.coalesce("words", F.array()), lambda w: w["x0"].isNotNull() & (F.coalesce(w["text"], F.lit("")) != ""))
    own = F.transform(words, lambda w: F.struct(w["text"].alias("text"), w["confidence"].cast("double").alias("confidence"), *(w[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))))
    line = F.struct(F.col("y0").cast("double").alias("y0"), F.col("x0").cast("double").alias("x0"), F.col("line").alias("line"), F.trim("text").alias("text"), own.alias("words"), (F.size(F.coalesce("words", F.array())) == 0).alias("bare"), word.alias("whole"))
    pages = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    spans = F.transform(F.col("lines"), lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("lines") - i)), lambda k: F.struct(i.alias("i"), k.alias("k"))))
    rows = pages.select(*keys, "lines", F.explode(F.flatten(spans)).alias("s")).select(*keys, "s.*", F.slice("lines", F.col("s.i") + 1, F.col("s.k")).alias("sub"))
    rows = rows.withColumn("text", F.array_join(F.transform("sub", lambda x: x["text"]), "\n")).withColumn("p", parse_position("text")).where("p.ok")
    score = F.col("p.best.score") - 0.3 * (F.col("k") - 1) - 0.5 * F.size("p.best.notes")
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("text", "p", "sub"), F.struct(score, -F.col("i"), -F.col("k"))).alias("b")).select(*keys, "b.*")
    bare = F.transform(F.filter("sub", lambda x: x["bare"]), lambda x: x["whole"])
    every = F.flatten(F.transform("sub", lambda x: x["words"]))
    telling = F.concat(F.filter(every, lambda w: vote.has_coordinate(w["text"])), bare)
    best = best.withColumn("words", F.when(F.size(telling) > 0, telling).otherwise(every)).where(F.size("words") > 0)
    side = lambda f, c: f(F.transform("words", lambda w: w[c])).alias(c)
    box = F.struct(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))
    return best.select(*keys, "text", "p", box.alias("box"), js_round(weighted(F.col("words"))).cast("int").alias("conf"))


def frame_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A reading frame: inside its photo, and no smaller than a frame may be."""
    bound = lambda v, low, high: F.greatest(F.lit(low), F.least(high, v))
    x, y = bound(x, 0.0, F.lit(1.0)), bound(y, 0.0, F.lit(1.0))
    return F.struct(x.alias("x"), y.alias("y"), bound(w, C.FRAME_LEAST, 1 - x).alias("w"), bound(h, C.FRAME_LEAST, 1 - y).alias("h"))


def _fitted(b: Column) -> Column:
    return frame_box(b["x"], b["y"], b["w"], b["h"])


def _left(open_: DataFrame, gone: Callable[[], DataFrame] | None) -> DataFrame:
    return open_.join(gone().select("photo"), "photo", "left_anti") if gone else open_


def find_zones(photos: DataFrame, read_view: Reader, gone: Callable[[], DataFrame] | None = None) -> DataFrame:
    """photo, ord, view, views, clean, text, p, box, conf: the zone of each photo that has one.

    photos: photo, has_screen. ``read_view`` gets photo, ord, view and returns these lines with photo and ord (see
    ``coordinate_zones``). A view is read of photos only that have no clean zone yet; ``views`` counts those read.
    """
    open_, zones, asked = photos.select("photo", "has_screen"), [], []
    for ord_, view in enumerate(VIEWS, 1):
        open_ = _left(open_, gone)
        requests = cut((open_.where("has_screen") if ord_ > 2 else open_).select("photo", F.lit(ord_).alias("ord"), F.lit(view).alias("view")))
        if requests.isEmpty():
            break
        asked.append(requests)
        found = coordinate_zones(read_view(requests), "photo", "ord")
        zones.append(cut(found.withColumns({"view": F.lit(view), "clean": clean(F.col("p")), "rank": zone_rank(F.col("p"))})))
        open_ = open_.join(zones[-1].where("clean").select("photo"), "photo", "left_anti")
    if not zones:
        return cut(coordinate_zones(read_view(photos.where("false").select("photo", F.lit(1).alias("ord"), F.lit(VIEWS[0]).alias("view"))), "photo", "ord").select("photo", "ord", F.lit("").alias("view"), F.lit(0).cast("long").alias("views"), F.lit(False).alias("clean"), "text", "p", "box", "conf"))
    every, read = zones[0], asked[0]
    for z, a in zip(zones[1:], asked[1:]):
        every, read = every.unionByName(z), read.unionByName(a)
    pick = F.max_by(F.struct("ord", "view", "clean", "text", "p", "box", "conf"), F.struct("clean", F.when(F.col("clean"), 0.0).otherwise(F.col("rank")), -F.col("ord")))
    best = every.groupBy("photo").agg(pick.alias("b")).select("photo", "b.*")
    return _left(best, gone).join(read.groupBy("photo").agg(F.count("*").alias("views")), "photo").select("photo", "ord", "view", "views", "clean", "text", "p", "box", "conf")


def frames(zones: DataFrame, photos: DataFrame, read_lean: Reader) -> DataFrame:
    """photo, angle, box: the reading frame around each zone, straightened where its lean is clear.

    photos: photo, w, h, angle (of the base image and its correction so far). ``read_lean`` gets photo, angle, box
    and returns photo, deg, gain. A zone that is not clean is widened by its neighbouring lines.
    """
    z = zones.join(photos.select("photo", "w", "h", F.col("angle").cast("double").alias("angle")), "photo")
    z = z.withColumn("size", rotated_size("w", "h", "angle"))
    pad = (F.col("box.y1") - F.col("box.y0")) * C.ZONE_PAD
    box = frame_box((F.col("box.x0") - pad) / F.col("size.w"), (F.col("box.y0") - pad) / F.col("size.h"), (F.col("box.x1") - F.col("box.x0") + 2 * pad) / F.col("size.w"), (F.col("box.y1") - F.col("box.y0") + 2 * pad) / F.col("size.h"))
    z = z.withColumn("box", box)
    z = cut(z.withColumn("box", F.when(F.col("clean"), F.col("box")).otherwise(_fitted(widen_box("box.x", "box.y", "box.w", "box.h")))))
    lean = read_lean(z.select("photo", "angle", "box")).select("photo", "deg", "gain")
    rows = z.join(lean, "photo", "left")
    tilt = F.greatest(F.lit(-C.TILT_MOST), F.least(F.lit(C.TILT_MOST), js_round((F.col("angle") - F.col("deg")) * 10) / 10))
    turn = F.coalesce((F.col("gain") >= C.LEAN_GAIN) & (F.abs("deg") >= C.ZONE_LEAN) & (tilt != F.col("angle")), F.lit(False))
    turned = _fitted(turn_box(F.col("box"), F.col("size"), rotated_size(F.col("w"), F.col("h"), tilt), tilt - F.col("angle")))
    return rows.select("photo", F.when(turn, tilt).otherwise(F.col("angle")).alias("angle"), F.when(turn, turned).otherwise(F.col("box")).alias("box"))


def heard(words: Column) -> Column:
    """The engine's confidence in a reading: of words with a digit, weighted by length, not rounded."""
    return weighted(F.filter(words, lambda w: F.coalesce(w["text"], F.lit("")).rlike("[0-9]")))


def read_box(requests: DataFrame, read_pass: Reader, limit: int = C.PASSES, gone: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The readings of each photo's box: up to ``limit`` passes, none after the votes of both axes are firm.

    requests: photo, box, ... ``read_pass`` gets them with pass_idx and returns photo, pass_idx, txt, words (array of
    text, confidence). The first passes that could be firm together are one round, each later one is its own.
    """
    open_, rounds, at = requests, [], 0
    none = F.array().cast(WORDS)
    while at < limit:
        end = min(limit, max(at + 1, C.VOTE_NEED))
        open_ = cut(_left(open_, gone)) if gone else open_
        if rounds and open_.isEmpty():
            break
        asked = open_.withColumn("pass_idx", F.explode(F.sequence(F.lit(at), F.lit(end - 1))))
        texts = read_pass(asked).select("photo", "pass_idx", F.trim("txt").alias("txt"), F.col("words").cast(WORDS).alias("words"))
        got = asked.select("photo", "pass_idx").join(texts, ["photo", "pass_idx"], "left")
        got = got.select("photo", "pass_idx", F.coalesce("txt", F.lit("")).alias("txt"), heard(F.coalesce("words", none)).alias("tess")).withColumn("p", parse_position("txt"))
        alts = F.transform("p.alts", lambda a: F.struct(a["lat"].alias("lat"), a["lon"].alias("lon")))
        # a round's readings are written once; the next votes read those before it
        rounds.append(cut(got.select("photo", "pass_idx", "txt", "p.ok", "p.best.lat", "p.best.lon", "p.best.fmt", F.coalesce("p.best.notes", F.array().cast("array<string>")).alias("notes"), alts.alias("alts"), "tess")))
        at = end
        if at < limit:
            made = reduce(DataFrame.unionByName, rounds).select("photo", "pass_idx", "ok", "lat", "lon", "notes")
            votes = vote.with_firm(vote.axis_votes(made.join(open_.select("photo"), "photo", "left_semi")))
            # cut as well: the plan of a round would hold those of all rounds before it, twice each
            open_ = cut(open_.join(votes.where("sure").select("photo"), "photo", "left_anti"))
    return _left(reduce(DataFrame.unionByName, rounds), gone)


def read_found(framed: DataFrame, read_pass: Reader, gone: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The settled reading of each frame, after a second try on the widened box where the first is not sure.

    The second is kept only if it is sure, or has a position where the first has none (``box``: found or wide).
    """
    first = cut(vote.settle(read_box(framed.select("photo", "box", F.lit("found").alias("which")), read_pass, C.PASSES, gone)))
    again = framed.join(first.where("not sure").select("photo"), "photo", "left_semi")
    wide = again.select("photo", widen_box("box.x", "box.y", "box.w", "box.h").alias("box"), F.lit("wide").alias("which"))
    second = cut(vote.settle(read_box(wide, read_pass, C.WIDE_PASSES, gone)))
    kept = vote.two_step(first, second)
    boxes = framed.select("photo", F.lit("found").alias("which"), "box").unionByName(wide.select("photo", "which", "box"))
    return _left(kept.withColumnRenamed("box", "which"), gone).join(boxes, ["photo", "which"])


def photo_chain(photos: DataFrame, read_view: Reader, read_lean: Reader, read_pass: Reader, gone: Callable[[], DataFrame] | None = None) -> DataFrame:
    """One row a photo: where its zone was found, the kept reading, its trust and its state.

    photos: photo, w, h, angle, quad (perspective was corrected), has_screen.
    """
    zones = cut(find_zones(photos, read_view, gone))
    framed = cut(frames(zones, photos, read_lean))
    res = cut(read_found(framed, read_pass, gone))
    trust = confidence(F.col("tess"), F.col("agree"), F.col("total"), F.col("sure"), F.col("rival"), F.size("notes"), F.size("alts"), F.lit(False))
    res = res.withColumn("trust", F.when(~F.col("none"), trust)).withColumnsRenamed({"box": "frame", "text": "read"})
    rows = _left(photos.select("photo", "quad", F.col("angle").cast("double").alias("first_angle")), gone)
    rows = rows.join(zones.select("photo", "ord", "view", "views", "clean"), "photo", "left").join(framed.select("photo", "angle"), "photo", "left").join(res, "photo", "left")
    angle = F.coalesce("angle", "first_angle")
    state = shot_state(F.col("ord").isNotNull(), F.coalesce(~F.col("none"), F.lit(False)), F.col("trust.level"), F.col("trust.pct"), F.col("quad"), angle)
    return rows.withColumn("state", state).select(
        "photo", F.col("ord").isNotNull().alias("found"), "ord", "view", "views", "clean", angle.alias("angle"), "which", F.col("frame").alias("box"), F.col("read").alias("text"), "lat", "lon", "fmt", "notes", "alts",
        "agree", "total", "tess", "sure", "rival", F.col("state.pct").alias("pct"), F.col("trust.level").alias("level"), F.col("trust.why").alias("why"), F.col("state.st").alias("st"), F.col("state.steps").alias("steps"),
    )
