"""Geodesy and orientation as column expressions: no UDF, whole-stage codegen throughout.

Angles are degrees, distances metres. Every function takes and returns Columns
(or names); nulls propagate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

from trailmark import constants as C

ColumnLike = Column | str | float | int


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def js_round(x: ColumnLike) -> Column:
    """Halves go up, also below zero."""
    return F.floor(col(x) + 0.5)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * C.SPHERE_M * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))  # least() would hide nulls


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def in_box(box, lat, lon) -> Column:
    return col(lat).between(box[0], box[1]) & col(lon).between(box[2], box[3])


def in_region(lat, lon) -> Column:
    return in_box(C.ALPS, lat, lon) | in_box(C.FRANCE, lat, lon)


def valid_position(lat, lon) -> Column:
    """Finite and on the globe; never null."""
    lat, lon = col(lat), col(lon)
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def route_check(lat, lon) -> Column:
    """struct(ok, swap, code) of ok, invalid, swapped, outside."""
    lat, lon = col(lat), col(lon)
    bad = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon) | (F.abs(lat) == math.inf) | (F.abs(lon) == math.inf)
    code = F.when(bad, "invalid").when(in_box(C.ROUTE_FRANCE, lat, lon), "ok").when(in_box(C.ROUTE_FRANCE, lon, lat), "swapped").otherwise("outside")
    return F.struct((code == "ok").alias("ok"), (code == "swapped").alias("swap"), code.alias("code"))


def cardinal(bearing) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in C.WINDS]), (F.pmod(js_round(col(bearing) / 22.5), F.lit(16)) + 1).cast("int"))


def turn(target, heading) -> Column:
    """Signed turn in [-180, 180)."""
    return F.pmod(col(target) - col(heading) + 180.0, F.lit(360.0)) - 180.0


def heading(alpha, beta, gamma, screen=0.0) -> Column:
    """Direction of the top of a flat screen, or of the back of an upright one, over the ground."""
    (ca, sa), (cb, sb), (cg, sg), (cs, ss) = ((F.cos(F.radians(col(x))), F.sin(F.radians(col(x)))) for x in (alpha, beta, gamma, screen))
    east = cs * (-sa * cb) + ss * (ca * cg - sa * sb * sg) - (ca * sg + sa * sb * cg)
    north = cs * (ca * cb) + ss * (sa * cg + ca * sb * sg) - (sa * sg - ca * sb * cg)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def pitch(beta, gamma) -> Column:
    up = -F.cos(F.radians(col(beta))) * F.cos(F.radians(col(gamma)))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))


def sight_angle(distance, z_point, z_me) -> Column:
    d = col(distance)
    rise = col(z_point) - (col(z_me) + 1.5) - 0.87 * d * d / (2 * C.SIGHT_SPHERE_M)
    return F.degrees(F.atan2(rise, d))


def declination(lon) -> Column:
    return 1.0 + 0.28 * col(lon)


def slope_pct(dz, distance) -> Column:
    return F.when(col(distance) >= 20, col(dz) * 100.0 / col(distance))


def slope_tag(dz) -> Column:
    return F.when(F.abs(col(dz)) < 5, "flat").when(col(dz) > 0, "up").otherwise("down")


def nice_step(span) -> Column:
    """The first of 1, 2, 5, 10 times a power of ten that cuts ``span`` in about four."""
    raw = col(span) / 4
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(raw, F.lit(1.0)))))
    steps = F.array(*[power * k for k in (1.0, 2.0, 5.0, 10.0)])
    return F.element_at(F.filter(steps, lambda s: s >= raw), 1)


def _e2() -> float:
    return C.WGS84_F * (2 - C.WGS84_F)


def utm_zone(lon) -> Column:
    return (F.floor((col(lon) + 180.0) / 6.0) + 1).cast("int")


def utm_band(lat) -> Column:
    at = F.least(F.lit(19), F.greatest(F.lit(0), F.floor((col(lat) + 80.0) / 8.0)))
    return F.substring(F.lit(C.UTM_BANDS), (at + 1).cast("int"), F.lit(1))


def utm_forward(lat, lon) -> tuple[Column, Column]:
    """Easting and northing in the standard zone (transverse Mercator series)."""
    e2 = _e2()
    ep2 = e2 / (1 - e2)
    p, dl = F.radians(col(lat)), F.radians(col(lon) - ((utm_zone(lon) - 1) * 6 - 180 + 3))
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    n, t2, c2, a = C.WGS84_A / F.sqrt(1 - e2 * s * s), t * t, ep2 * c * c, c * dl
    # meridian arc: coefficients of p, sin 2p, sin 4p, sin 6p
    arc = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 15 * e2**2 / 256 + 45 * e2**3 / 1024, -35 * e2**3 / 3072]
    m = C.WGS84_A * reduce(lambda x, y: x + y, [arc[0] * p, *(arc[i] * F.sin(2 * i * p) for i in (1, 2, 3))])
    east = C.UTM_K0 * n * (a + (1 - t2 + c2) * F.pow(a, F.lit(3.0)) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * ep2) * F.pow(a, F.lit(5.0)) / 120) + 500000.0
    rise = a * a / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * F.pow(a, F.lit(4.0)) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * ep2) * F.pow(a, F.lit(6.0)) / 720
    north = C.UTM_K0 * (m + n * t * rise)
    return east, F.when(col(lat) < 0, north + 10_000_000.0).otherwise(north)


def utm_inverse(zone, band, easting, northing) -> tuple[Column, Column]:
    """Latitude and longitude; band letters before N lie south."""
    out = utm_position(zone, band, easting, northing, lambda value, body: body(value))
    return out["lat"], out["lon"]


def utm_position(zone, band, easting, northing, let) -> Column:
    """struct(lat, lon) of ``utm_inverse``; ``let`` binds what is used more than once."""
    return let(_footpoint(band, northing), lambda p: let(F.struct(F.sin(p).alias("s"), F.cos(p).alias("c"), F.tan(p).alias("t")), lambda f: _from_foot(zone, col(easting) - 500000.0, p, f["s"], f["c"], f["t"], let)))


def _footpoint(band, northing) -> Column:
    e2 = _e2()
    y = F.when(col(band) < "N", col(northing) - 10_000_000.0).otherwise(col(northing))
    mu = y / C.UTM_K0 / (C.WGS84_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    foot = {2: 3 * e1 / 2 - 27 * e1**3 / 32, 4: 21 * e1**2 / 16 - 55 * e1**4 / 32, 6: 151 * e1**3 / 96, 8: 1097 * e1**4 / 512}
    return reduce(lambda a, b: a + b, [mu, *(k * F.sin(i * mu) for i, k in foot.items())])


def _from_foot(zone, x: Column, p: Column, s: Column, c: Column, t: Column, let) -> Column:
    e2 = _e2()
    ep2 = e2 / (1 - e2)
    n = C.WGS84_A / F.sqrt(1 - e2 * s * s)
    r = C.WGS84_A * (1 - e2) / F.pow(1 - e2 * s * s, F.lit(1.5))

    def made(v: Column) -> Column:
        t2, c2, d = v["t2"], v["c2"], v["d"]
        fall = d * d / 2 - (5 + 3 * t2 + 10 * c2 - 4 * c2 * c2 - 9 * ep2) * F.pow(d, F.lit(4.0)) / 24 + (61 + 90 * t2 + 298 * c2 + 45 * t2 * t2 - 252 * ep2 - 3 * c2 * c2) * F.pow(d, F.lit(6.0)) / 720
        lat = F.degrees(p - n * t / r * fall)
        side = d - (1 + 2 * t2 + c2) * F.pow(d, F.lit(3.0)) / 6 + (5 - 2 * c2 + 28 * t2 - 3 * c2 * c2 + 8 * ep2 + 24 * t2 * t2) * F.pow(d, F.lit(5.0)) / 120
        return F.struct(lat.alias("lat"), ((col(zone) - 1) * 6 - 180 + 3 + F.degrees(side / c)).alias("lon"))

    return let(F.struct((t * t).alias("t2"), (ep2 * c * c).alias("c2"), (x / (n * C.UTM_K0)).alias("d")), made)


def projected(quad_h: list, x, y) -> tuple[Column, Column]:
    """A homography of nine numbers applied to a point."""
    h = [F.lit(float(v)) for v in quad_h]
    w = h[6] * col(x) + h[7] * col(y) + h[8]
    return (h[0] * col(x) + h[1] * col(y) + h[2]) / w, (h[3] * col(x) + h[4] * col(y) + h[5]) / w


def widen_box(x, y, w, h) -> Column:
    """A box of fractions widened by one line above and below, and a little aside."""
    x0, y0 = F.greatest(F.lit(0.0), col(x) - col(w) * 0.15), F.greatest(F.lit(0.0), col(y) - col(h))
    x1, y1 = F.least(F.lit(1.0), col(x) + col(w) * 1.15), F.least(F.lit(1.0), col(y) + col(h) * 2)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def quad_area(xs, ys) -> Column:
    """Shoelace area of a polygon given as arrays of its corners."""
    xs, ys, n = col(xs), col(ys), F.size(col(xs))
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(xs, i) * F.element_at(ys, i % n + 1) - F.element_at(xs, i % n + 1) * F.element_at(ys, i))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2


def rotated_size(w, h, deg) -> Column:
    """struct(w, h): the extent of an image turned by some degrees."""
    c, s = F.abs(F.cos(F.radians(col(deg)))), F.abs(F.sin(F.radians(col(deg))))
    return F.struct((col(w) * c + col(h) * s).alias("w"), (col(w) * s + col(h) * c).alias("h"))


def turn_box(box: Column, size: Column, turned: Column, deg) -> Column:
    """A box of fractions found again in the image turned by ``deg``: same spot, same size in pixels.

    box: struct(x, y, w, h); size and turned: struct(w, h) of the two images.
    """
    c, s = F.cos(F.radians(col(deg))), F.sin(F.radians(col(deg)))
    dx = (box["x"] + box["w"] / 2 - 0.5) * size["w"]
    dy = (box["y"] + box["h"] / 2 - 0.5) * size["h"]
    w, h = F.least(F.lit(1.0), box["w"] * size["w"] / turned["w"]), F.least(F.lit(1.0), box["h"] * size["h"] / turned["h"])
    return fit_box((dx * c - dy * s) / turned["w"] + 0.5 - w / 2, (dx * s + dy * c) / turned["h"] + 0.5 - h / 2, w, h)


def fit_box(x, y, w, h) -> Column:
    """A box kept inside its image."""
    bound = lambda v, low, high: F.greatest(low, F.least(high, v))
    w, h = bound(col(w), F.lit(0.0), F.lit(1.0)), bound(col(h), F.lit(0.0), F.lit(1.0))
    return F.struct(bound(col(x), F.lit(0.0), 1 - w).alias("x"), bound(col(y), F.lit(0.0), 1 - h).alias("y"), w.alias("w"), h.alias("h"))
