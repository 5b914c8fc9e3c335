"""Tracks: time-ordered sightings, one row a point (track, seq, t, lat, lon, ...).

The order of a track is (t, seq): a stable sort by date. All window operators
share one partitioning and ordering, so chains of them cost one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark import constants as C
from trailmark.functions import text as T
from trailmark.functions.geo import bearing_deg, haversine_m, js_round, nice_step, slope_pct, slope_tag, valid_position

HOUR_MS = 3_600_000.0


def ordered(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("track",))).orderBy("t", "seq")


def millis(c: Column | str = "t") -> Column:
    return F.unix_millis(F.col(c) if isinstance(c, str) else c)


def speed_m_h(metres: Column, ms: Column) -> Column:
    """Null under ten minutes, where a speed means nothing."""
    return F.when(ms >= C.MIN_DT_MS, metres * HOUR_MS / ms)


def with_legs(points: DataFrame) -> DataFrame:
    """Each point with the leg that leads to it: i, d, b, dt, v (null on the first)."""
    w = ordered()
    before = lambda c: F.lag(c).over(w)
    out = points.withColumns({"i": F.row_number().over(w) - 1, "d": haversine_m(before("lat"), before("lon"), "lat", "lon"), "b": bearing_deg(before("lat"), before("lon"), "lat", "lon"), "dt": millis() - millis(before("t"))})
    return out.withColumn("v", speed_m_h(F.col("d"), F.col("dt")))


def legs(points: DataFrame) -> DataFrame:
    return with_legs(points).where("i > 0").select("track", "seq", "i", "d", "b", "dt", "v")


def summary(points: DataFrame) -> DataFrame:
    """n, total, dt, v, direct, bearing and the last leg's length of each track."""
    key, end = F.struct("t", "seq"), F.struct("lat", "lon", "t")
    out = with_legs(points).groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("total"), F.min_by(end, key).alias("a"), F.max_by(end, key).alias("z"), F.max_by("d", key).alias("last_d")
    )
    dt, far = millis("z.t") - millis("a.t"), ("a.lat", "a.lon", "z.lat", "z.lon")
    more = F.col("n") > 1
    return out.select(
        "track", "n", "total", dt.alias("dt"), speed_m_h(F.col("total"), dt).alias("v"), F.when(more, haversine_m(*far)).otherwise(0.0).alias("direct"), F.when(more, bearing_deg(*far)).alias("bearing"), "last_d"
    )


def ranked(points: DataFrame) -> DataFrame:
    return points.withColumn("rank", F.row_number().over(ordered()))


def last_points(points: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("lat", "lon", "t", "seq"), F.struct("t", "seq"))
    return points.groupBy("track").agg(last.alias("p")).select("track", "p.*")


def with_distance(points: DataFrame) -> DataFrame:
    """Cumulative distance from the first point."""
    return with_legs(points).withColumn("cum", F.sum(F.coalesce("d", F.lit(0.0))).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


def is_dup(p: str, q: str) -> Column:
    """Less than three metres and one minute apart."""
    near = haversine_m(f"{p}.lat", f"{p}.lon", f"{q}.lat", f"{q}.lon") < C.DUP_M
    return near & (F.abs(millis(f"{p}.t") - millis(f"{q}.t")) < C.DUP_MS)


LAT_CELL = 3.0 / 111_000  # a little more than 3 m of latitude


def dup_cells(lat: str, lon: str, t: str) -> tuple[Column, Column, Column]:
    """Grid cells (latitude, longitude by its latitude's row, minute) for the near-duplicate test."""
    row = F.floor(F.col(lat) / LAT_CELL).cast("long")
    return row, F.lit(0).cast("long"), F.floor(millis(t) / C.DUP_MS).cast("long")


def near_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of b with each row of a that they duplicate: an equi-join on neighbouring cells.

    Cells are three metres of latitude by one minute; longitude stays a residual,
    so its shrinking degrees need no care. ``a`` is spread to its nine neighbours.
    """
    row, _, minute = dup_cells("lat", "lon", "t")
    spread = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct((row + i).alias("r"), (minute + j).alias("m"))))))
    left = a.withColumn("cell", spread).select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.col("cell.r").alias("a_r"), F.col("cell.m").alias("a_m"))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], row.alias("b_r"), minute.alias("b_m"))
    met = left.join(right, F.expr("a_track = b_track AND a_r = b_r AND a_m = b_m"))
    near = (haversine_m("a_lat", "a_lon", "b_lat", "b_lon") < C.DUP_M) & (F.abs(millis("a_t") - millis("b_t")) < C.DUP_MS)
    return met.where(near).select(*[F.col(f"a_{c}") for c in a.columns], *[F.col(f"b_{c}").alias(c) for c in b.columns])


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with the rows of b that duplicate nothing accepted before (a, then b in order).

    Rows of b near a row of a go by a blocked anti-join. Those left are folded in
    order per track and chain of neighbouring minutes, as near-duplicates are not
    transitive; tracks or times far apart never share a fold.
    """
    columns = ["track", "seq", "t", "lat", "lon", "label"]
    hit = near_pairs(a.select("track", "seq", "t", "lat", "lon"), b.select("track", "seq", "t", "lat", "lon")).select("track", "seq").distinct()
    left = b.join(hit, ["track", "seq"], "left_anti")
    w = Window.partitionBy("track").orderBy("t", "seq")
    gap = F.coalesce(millis() - millis(F.lag("t").over(w)) >= C.DUP_MS, F.lit(True))
    runs = left.withColumn("run", F.sum(gap.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("seq", "t", "lat", "lon", "label")
    runs = runs.groupBy("track", "run").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def clash(x, acc):
        return F.exists(acc, lambda y: (haversine_m(x["lat"], x["lon"], y["lat"], y["lon"]) < C.DUP_M) & (F.abs(millis(x["t"]) - millis(y["t"])) < C.DUP_MS))

    empty = F.slice(F.col("xs"), 1, 0)
    kept = runs.withColumn("xs", F.aggregate("xs", empty, lambda acc, x: F.when(clash(x, acc), acc).otherwise(F.concat(acc, F.array(x)))))
    added = kept.select("track", F.explode("xs").alias("x")).select("track", "x.*")
    return a.select(*columns).withColumn("origin", F.lit("a")).unionByName(added.select(*columns).withColumn("origin", F.lit("b")))


def find_points(points: DataFrame, queries: DataFrame) -> DataFrame:
    """qid -> 1-based rank in its track, by key, else by the near-duplicate test, else 0.

    points: track, seq, t, lat, lon, key; queries: qid, track, t, lat, lon, key.
    """
    ranks = ranked(points)
    by_key = queries.where("key is not null").join(ranks.select("track", "key", "rank"), ["track", "key"]).groupBy("qid").agg(F.min("rank").alias("k"))
    near = near_pairs(ranks.select("track", "seq", "t", "lat", "lon", "rank"), queries.select("qid", "track", "t", "lat", "lon")).groupBy("qid").agg(F.min("a_rank").alias("n"))
    out = queries.join(by_key, "qid", "left").join(near, "qid", "left")
    return out.select("qid", "track", F.coalesce("k", "n", F.lit(0)).alias("rank"))


def place_points(points: DataFrame, queries: DataFrame) -> DataFrame:
    """How each query (one a track, or independent ones) enters its track: added, moved, same, dup.

    A keyed point is corrected in place and keeps its date unless ``dated``.
    """
    first_key = points.where("key is not null").groupBy("track", "key").agg(F.min_by(F.struct("seq", "t", "lat", "lon"), F.struct("t", "seq")).alias("k"))
    near = near_pairs(points.select("track", "seq", "t", "lat", "lon", "key"), queries.select("qid", "track", "t", "lat", "lon"))
    near = near.groupBy("qid").agg(F.min_by(F.struct(F.col("a_seq").alias("seq"), F.col("a_key").alias("key")), F.struct("a_t", "a_seq")).alias("n"))
    out = queries.join(first_key, ["track", "key"], "left").join(near, "qid", "left")
    still = (haversine_m("k.lat", "k.lon", "lat", "lon") < C.SAME_M) & ~(F.col("dated") & (F.col("k.t") != F.col("t")))
    how = F.when(F.col("k").isNotNull(), F.when(still, "same").otherwise("moved")).when(F.col("n").isNotNull(), "dup").otherwise("added")
    date = F.when(F.col("k").isNotNull() & ~F.col("dated"), F.col("k.t")).otherwise(F.col("t"))
    adopts = (how == "dup") & F.col("key").isNotNull() & F.col("n.key").isNull()
    return out.select("qid", "track", how.alias("how"), F.coalesce("k.seq", "n.seq").alias("seq"), date.alias("t"), adopts.alias("adopts_key"))


def moved_dates(points: DataFrame) -> DataFrame:
    """New dates of points that were moved to ``place`` in their track.

    points: track, place (order after the move), t, t0, moved. The original date
    comes back if it fits its new neighbours; else the middle, or a minute off one.
    """
    w = Window.partitionBy("track").orderBy("place")
    a, b = F.lag("ms").over(w), F.lead("ms").over(w)
    rows = points.withColumns({"ms": millis(), "ms0": millis("t0")}).withColumns({"a": a, "b": b})
    fits = F.coalesce(F.col("a") <= F.col("ms0"), F.lit(True)) & F.coalesce(F.col("ms0") <= F.col("b"), F.lit(True))
    between = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(F.col("a") < F.col("b"), F.floor((F.col("a") + F.col("b")) / 2)).otherwise(F.col("a") + 60000)).when(F.col("a").isNotNull(), F.col("a") + 60000).otherwise(F.col("b") - 60000)
    new = F.when(~F.col("moved"), F.col("ms")).when(fits, F.col("ms0")).otherwise(between)
    src = F.when(F.col("moved") & ~fits, "moved").otherwise("kept")
    return rows.select("track", "place", F.coalesce(new, F.col("ms")).cast("long").alias("ms"), src.alias("src"))


def path_samples(points: DataFrame, n: int = 100) -> DataFrame:
    """track, k, f, lat, lon, d: vertices (k >= 0) and points between them in proportion to leg length."""
    rows = with_distance(points).withColumns({"plat": F.lag("lat").over(ordered()), "plon": F.lag("lon").over(ordered())})
    size = Window.partitionBy("track")
    rows = rows.withColumns({"total": F.sum(F.coalesce("d", F.lit(0.0))).over(size), "extra": F.greatest(F.lit(0), n - F.count(F.lit(1)).over(size))})
    m = F.when((F.col("i") > 0) & (F.col("total") > 0), js_round(F.col("extra") * F.col("d") / F.col("total"))).otherwise(0).cast("int")
    rows = rows.withColumn("m", m)
    # j = m + 1 is the vertex itself
    cut = rows.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("m") + 1))).withColumn("f", F.col("j") / (F.col("m") + 1))
    vertex = F.col("j") == F.col("m") + 1
    mid = lambda a, b: F.when(vertex, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col("f"))
    d = F.when(vertex, F.col("cum")).otherwise(F.col("cum") - F.col("d") + F.col("d") * F.col("f"))
    return cut.select("track", "i", "j", F.when(vertex, F.col("i")).otherwise(-1).alias("k"), mid("plat", "lat").alias("lat"), mid("plon", "lon").alias("lon"), d.alias("d"))


def climb_totals(points: DataFrame) -> DataFrame:
    """Metres up and down over ``z``; a pair with an unknown end counts for nothing."""
    dz = F.col("z") - F.lag("z").over(ordered())
    rows = points.withColumn("dz", dz)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.groupBy("track").agg(total(F.when(F.col("dz") > 0, F.col("dz"))).alias("up"), total(F.when(F.col("dz") < 0, -F.col("dz"))).alias("down"))


def leg_slopes(points: DataFrame) -> DataFrame:
    rows = with_legs(points).withColumn("dz", F.col("z") - F.lag("z").over(ordered())).where("i > 0")
    return rows.select("track", "i", "dz", slope_pct("dz", "d").alias("slope"), F.when(F.col("dz").isNotNull(), slope_tag("dz")).alias("tag"))


def profile_scale(points: DataFrame, least: float = 20.0) -> DataFrame:
    """Lowest, highest, widened span and graduation of each track's altitudes."""
    out = points.groupBy("track").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(least))
    return out.select("track", "low", "high", span.alias("span"), nice_step(span).alias("step"))


def pack_fallback(points: DataFrame, first: DataFrame, second: DataFrame, size: int = C.ALTITUDE_PACK, key: Column | None = None) -> DataFrame:
    """Altitudes by packs: the first source only where it knows the whole pack, else the second.

    points: track, seq, lat, lon; sources: key, z by rounded point. Both lookups are
    left joins on distinct keys, which Spark broadcasts while they are small.
    """
    # row_number needs an order inside a track; packs are cut there
    rows = points.withColumn("key", T.point_key("lat", "lon") if key is None else key).withColumn("pack", F.floor((F.row_number().over(Window.partitionBy("track").orderBy("seq")) - 1) / size))
    rows = rows.join(first.withColumnRenamed("z", "z1"), "key", "left").join(second.withColumnRenamed("z", "z2"), "key", "left")
    whole = F.min(F.col("z1").isNotNull()).over(Window.partitionBy("track", "pack"))
    return rows.select("track", "seq", "pack", F.when(whole, F.col("z1")).otherwise(F.col("z2")).alias("z"), F.when(whole, "first").otherwise("second").alias("source"))


def history(entries: DataFrame, keep: int = C.HISTORY_KEPT) -> DataFrame:
    """The newest ``keep`` keys of each owner, newest first (owner, k, src, t)."""
    newest = Window.partitionBy("owner", "k").orderBy(F.desc("t"), F.desc("seq"))
    top = Window.partitionBy("owner").orderBy(F.desc("t"), F.desc("seq"))
    rows = entries.withColumn("n", F.row_number().over(newest)).where("n = 1").withColumn("place", F.row_number().over(top)).where(F.col("place") <= keep)
    return rows.select("owner", "place", "k", F.substring("src", 1, C.HISTORY_CHARS).alias("src"), "t")


def dwelt(positions: DataFrame, seconds: float = C.HISTORY_DWELL_S) -> DataFrame:
    """Positions still current after ``seconds`` (the last of an owner always is)."""
    w = Window.partitionBy("owner").orderBy("t", "seq")
    stay = F.lead("t").over(w)
    return positions.withColumn("next_t", stay).where(F.col("next_t").isNull() | (millis("next_t") - millis() >= int(seconds * 1000))).drop("next_t")


def in_order(items: Column) -> Column:
    return F.array_sort(F.collect_list(items))


def encode_links(points: DataFrame) -> DataFrame:
    """track, hash: name and points of each track as a link fragment (name column ``name``)."""
    part = F.concat(T.degrees6("lat"), F.lit(","), T.degrees6("lon"), F.lit(","), F.floor(millis() / 1000 + 0.5).cast("string"), F.lit(","), T.uri_component(F.coalesce("label", F.lit(""))))
    rows = points.select("track", F.coalesce("name", F.lit("")).alias("name"), F.struct("t", "seq", part.alias("s")).alias("x"))
    out = rows.groupBy("track").agg(F.first("name").alias("name"), in_order(F.col("x")).alias("xs"))
    return out.select("track", F.concat(F.lit("s="), T.uri_component("name"), F.concat_ws("", F.transform("xs", lambda x: F.concat(F.lit("~"), x["s"])))).alias("hash"))


def decode_links(links: DataFrame) -> DataFrame:
    """id, name, seq, lat, lon, t (ms), label of link fragments; ill-formed points are left out."""
    body = F.regexp_replace(F.coalesce("hash", F.lit("")), "^#", "")
    rows = links.select("id", body.alias("h")).where(F.col("h").startswith("s=")).select("id", F.split(F.substring("h", 3, 1 << 30), "~").alias("p"))
    name = F.substring(T.uri_decode(F.element_at("p", 1)), 1, C.LABEL_CHARS)
    rows = rows.select("id", name.alias("name"), F.posexplode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("seq", "f"))
    rows = rows.withColumn("f", F.split("f", ","))
    number = lambda i: F.when(F.trim(F.get("f", F.lit(i))) == "", 0.0).otherwise(F.expr(f"try_cast(trim(get(f, {i})) AS double)"))
    rows = rows.select("id", "name", "seq", number(0).alias("lat"), number(1).alias("lon"), (number(2) * 1000).alias("t"), F.substring(T.uri_decode(F.coalesce(F.get("f", F.lit(3)), F.lit(""))), 1, C.LABEL_CHARS).alias("label"))
    return rows.where(valid_position("lat", "lon") & F.col("t").isNotNull() & ~F.isnan("t")).withColumn("t", F.col("t").cast("long"))


def iso(t: Column | str = "t") -> Column:
    """UTC in ISO 8601, in any session zone."""
    ms = millis(t)
    whole = F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.floor(ms / 1000).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))


def to_gpx(points: DataFrame, creator: str = "trailmark") -> DataFrame:
    """track, gpx: one GPX 1.1 document a track, waypoints and one segment."""
    numbered = ranked(points).withColumn("head", F.concat(F.lit('lat="'), T.degrees6("lat"), F.lit('" lon="'), T.degrees6("lon"), F.lit('"><time>'), iso(), F.lit("</time>")))
    label = F.coalesce("label", F.lit(""))
    title = T.xml_escape(F.concat(F.col("rank").cast("string"), F.when(label != "", F.concat(F.lit(" · "), label)).otherwise("")))
    rows = numbered.select("track", F.coalesce(F.nullif("name", F.lit("")), F.lit("Track")).alias("name"), F.struct("rank", F.concat(F.lit("  <wpt "), "head", F.lit("<name>"), title, F.lit("</name></wpt>")).alias("w"), F.concat(F.lit("      <trkpt "), "head", F.lit("</trkpt>")).alias("p")).alias("x"))
    out = rows.groupBy("track").agg(T.xml_escape(F.first("name")).alias("name"), in_order(F.col("x")).alias("xs"))
    lines = lambda f: F.array_join(F.transform("xs", lambda x: x[f]), "\n")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata><name>'
    return out.select("track", F.concat(F.lit(head), "name", F.lit("</name></metadata>\n"), lines("w"), F.lit("\n  <trk><name>"), "name", F.lit("</name><trkseg>\n"), lines("p"), F.lit("\n    </trkseg></trk>\n</gpx>\n")).alias("gpx"))


def from_gpx(files: DataFrame) -> DataFrame:
    """id, name, seq, lat, lon, t (ms), label: waypoints if a file has any, else track points."""
    point = r"(?s)<(?:wpt|trkpt)\s+[^>]*?(?:/>|>.*?</(?:wpt|trkpt)>)"
    name = F.coalesce(F.nullif(F.regexp_extract("gpx", r"(?s)<metadata>.*?<name>([^<]*)</name>", 1), F.lit("")), F.regexp_extract("gpx", r"<trk>\s*<name>([^<]*)</name>", 1))
    rows = files.select("id", F.substring(F.trim(T.xml_unescape(name)), 1, C.LABEL_CHARS).alias("name"), F.posexplode(F.regexp_extract_all("gpx", F.lit(point), F.lit(0))).alias("seq", "x"))
    number = lambda a: F.expr(f"""try_cast(nullif(regexp_extract(x, '{a}="([^"]+)"', 1), '') AS double)""")
    time = F.try_to_timestamp(F.nullif(F.regexp_extract("x", "<time>([^<]*)</time>", 1), F.lit("")))
    label = T.xml_unescape(F.regexp_extract("x", "<name>([^<]*)</name>", 1))
    label = F.regexp_replace(F.regexp_replace(label, r"^\d+ · ", ""), r"^\d+$", "")
    rows = rows.select("id", "name", "seq", F.col("x").startswith("<wpt").alias("wpt"), number("lat").alias("lat"), number("lon").alias("lon"), F.coalesce(F.unix_millis(time), F.lit(0)).alias("t"), F.substring(label, 1, C.LABEL_CHARS).alias("label"))
    rows = rows.where(valid_position("lat", "lon"))
    any_wpt = F.max("wpt").over(Window.partitionBy("id"))
    return rows.withColumn("any", any_wpt).where(F.col("wpt") == F.col("any")).drop("wpt", "any")


def messages(points: DataFrame, title: str = "Suivi") -> DataFrame:
    """track, text: points, legs and totals for people (altitudes ``z`` where known)."""
    from trailmark.functions.geo import cardinal

    rows = with_legs(points).withColumn("dz", F.col("z") - F.lag("z").over(ordered()))
    label = F.coalesce("label", F.lit(""))
    line = F.concat((F.col("i") + 1).cast("string"), F.lit(". "), T.when_text("t"), F.when(label != "", F.concat(F.lit(" "), label)).otherwise(""), F.lit(" : "), T.degrees6("lat"), F.lit(", "), T.degrees6("lon"), F.when(F.col("z").isNotNull(), F.concat(F.lit(", alt. "), T.altitude_text("z"))).otherwise(""))
    speed = lambda v: F.when(v.isNotNull(), F.concat(F.lit(" ("), T.speed_text(v), F.lit(")"))).otherwise("")
    heading = lambda b: F.concat(F.lit(", cap "), js_round(b).cast("string"), F.lit("° "), cardinal(b))
    rise = lambda dz: F.when(dz.isNotNull(), F.concat(F.lit(", dénivelé "), T.delta_text(dz))).otherwise("")
    leg = F.concat(F.lit("   "), T.distance_text("d"), F.lit(" depuis le point "), F.col("i").cast("string"), heading(F.col("b")), rise(F.col("dz")), F.lit(", en "), T.duration_text("dt"), speed(F.col("v")))
    body = rows.groupBy("track").agg(in_order(F.struct("i", F.concat_ws("\n", line, F.when(F.col("i") > 0, leg)).alias("s"))).alias("xs"), F.min_by("z", F.struct("t", "seq")).alias("z0"), F.max_by("z", F.struct("t", "seq")).alias("z1"))
    out = body.join(summary(points), "track")
    total = F.concat(F.lit("Total : "), T.distance_text("total"), F.lit(" en "), T.duration_text("dt"), speed(F.col("v")), F.lit(", "), T.distance_text("direct"), F.lit(" à vol d’oiseau du premier au dernier point"), heading(F.col("bearing")), rise(F.col("z1") - F.col("z0")))
    head = F.concat(F.lit(f"{title} : "), F.col("n").cast("string"), F.lit(" point"), F.when(F.col("n") > 1, "s").otherwise(""))
    return out.select("track", F.concat_ws("\n", head, F.array_join(F.transform("xs", lambda x: x["s"]), "\n"), F.when(F.col("n") > 1, total)).alias("text"))


def import_tracks(current: DataFrame, incoming: DataFrame, on_conflict: str = "replace") -> DataFrame:
    """track, policy for tracks that arrive: merge, replace or keep.

    current, incoming: track, name, n. An empty, equally named or unnamed track is merged.
    """
    rows = incoming.alias("b").join(current.alias("a"), "track", "left")
    same = F.coalesce("a.n", F.lit(0)) == 0
    same = same | (F.coalesce("a.name", F.lit("")) == F.coalesce("b.name", F.lit(""))) | (F.coalesce("b.name", F.lit("")) == "") | (F.coalesce("a.name", F.lit("")) == "")
    return rows.select("track", F.when(same, "merge").otherwise(on_conflict).alias("policy"))


def point_altitudes(samples: DataFrame, altitudes: DataFrame) -> DataFrame:
    """track, k, z of the vertices of sampled paths; altitudes: track, i, j, z by sample."""
    rows = samples.where("k >= 0").join(altitudes, ["track", "i", "j"], "left")
    return rows.select("track", "k", "z")


def put_points(points: DataFrame, queries: DataFrame) -> DataFrame:
    """``place_points`` with the 1-based rank that each point has in its track afterwards (one query a track).

    Dates count to the millisecond; the rank of a duplicate is that of the point it repeats, which keeps its date.
    """
    placed = place_points(points, queries)
    stored = points.select("track", F.col("seq").alias("own"), F.col("t").alias("own_t"))
    put = placed.select("track", "qid", "how", F.col("t").alias("put_t"), F.col("seq").alias("own")).join(stored, ["track", "own"], "left")
    put = put.select("track", "qid", "own", millis(F.when(F.col("how") == "dup", F.col("own_t")).otherwise(F.col("put_t"))).alias("put_ms"))
    earlier = (millis() < F.col("put_ms")) | ((millis() == F.col("put_ms")) & (F.col("own").isNull() | (F.col("seq") < F.col("own"))))
    before = points.join(put, "track").where((F.col("own").isNull() | (F.col("seq") != F.col("own"))) & earlier)
    rank = before.groupBy("qid").agg(F.count(F.lit(1)).alias("before"))
    return placed.join(rank, "qid", "left").withColumn("rank", F.coalesce("before", F.lit(0)) + 1).drop("before")


def resume_texts(points: DataFrame) -> DataFrame:
    """track, text: how many points a stored track has and when its last was seen."""
    out = points.groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"))
    return out.select("track", F.concat(F.col("n").cast("string"), F.lit(" point"), F.when(F.col("n") > 1, "s").otherwise(""), F.lit(", "), T.when_text("last")).alias("text"))
