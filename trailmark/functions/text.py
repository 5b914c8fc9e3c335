"""Texts for people and for links, as column expressions.

Decimal text comes from ``format_string``, which rounds halves of the shortest
decimal form up.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trailmark import constants as C
from trailmark.functions.geo import cardinal, col, js_round, utm_band, utm_forward, utm_zone

DEGREE = "°"


def fixed(x, digits: int) -> Column:
    return F.when(col(x).isNotNull(), F.format_string(f"%.{digits}f", col(x)))


def pad_left(text: Column, width: int) -> Column:
    """Zeros on the left; longer texts stay whole."""
    text = text.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def degrees6(x) -> Column:
    return fixed(x, 6)


def distance_text(d) -> Column:
    d = col(d)
    km = F.when(d < 10000, fixed(d / 1000, 2)).otherwise(fixed(d / 1000, 1))
    return F.when(js_round(d) < 1000, F.concat(js_round(d).cast("string"), F.lit(" m"))).otherwise(F.concat(F.replace(km, F.lit("."), F.lit(",")), F.lit(" km")))


def duration_text(ms) -> Column:
    m = js_round(col(ms) / 60000).cast("long")
    h = F.floor(m / 60)
    d = F.floor(h / 24)
    text = F.when(d > 0, F.concat(d.cast("string"), F.lit(" j "), (h % 24).cast("string"), F.lit(" h")))
    text = text.when(h > 0, F.concat(h.cast("string"), F.lit(" h "), F.lpad((m % 60).cast("string"), 2, "0"))).otherwise(F.concat(m.cast("string"), F.lit(" min")))
    return F.when(F.coalesce(col(ms) > 0, F.lit(False)), text).otherwise("0 min")


def speed_text(v) -> Column:
    v = col(v)
    text = F.when(v < 1000, F.concat(js_round(v).cast("string"), F.lit(" m/h"))).otherwise(F.concat(F.replace(fixed(v / 1000, 1), F.lit("."), F.lit(",")), F.lit(" km/h")))
    return F.coalesce(text, F.lit(""))


def grouped(n: Column) -> Column:
    """Thousands set apart by a narrow no-break space."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def altitude_text(z) -> Column:
    return F.concat(grouped(js_round(z)), F.lit(" m"))


def delta_text(d) -> Column:
    n = js_round(d)
    return F.concat(F.when(n > 0, "+").when(n < 0, "−").otherwise("±"), grouped(F.abs(n)), F.lit(" m"))


def when_text(t) -> Column:
    return F.date_format(col(t), "dd/MM HH:mm")


def local_value(t) -> Column:
    return F.date_format(col(t), "yyyy-MM-dd'T'HH:mm")


def signed_degrees(v) -> Column:
    return F.concat(F.when(col(v) > 0, "+").otherwise(""), F.replace(fixed(v, 1), F.lit("."), F.lit(",")), F.lit(DEGREE))


def hemisphere(v, is_lat: bool) -> Column:
    return F.when(col(v) < 0, "S" if is_lat else "O").otherwise("N" if is_lat else "E")


def dmm_text(v, is_lat: bool) -> Column:
    a = F.abs(col(v))
    d, m = F.floor(a), (a - F.floor(a)) * 60
    up = fixed(m, 3).cast("double") >= 60
    d, m = F.when(up, d + 1).otherwise(d), F.when(up, 0.0).otherwise(m)
    return F.concat(hemisphere(v, is_lat), F.lit(" "), pad_left(d, 2 if is_lat else 3), F.lit(DEGREE), pad_left(fixed(m, 3), 6), F.lit("'"))


def dms_text(v, is_lat: bool) -> Column:
    a = F.abs(col(v))
    d, mf = F.floor(a), (a - F.floor(a)) * 60
    m, s = F.floor(mf), (mf - F.floor(mf)) * 60
    up = fixed(s, 1).cast("double") >= 60
    m, s = F.when(up, m + 1).otherwise(m), F.when(up, 0.0).otherwise(s)
    d, m = F.when(m >= 60, d + 1).otherwise(d), F.when(m >= 60, 0).otherwise(m)
    return F.concat(hemisphere(v, is_lat), F.lit(" "), pad_left(d, 2 if is_lat else 3), F.lit(DEGREE), pad_left(m, 2), F.lit("'"), pad_left(fixed(s, 1), 4), F.lit('"'))


def pilot_entry(v) -> Column:
    """struct(d, m): signed whole degrees and minutes to four decimals."""
    a = F.abs(col(v))
    d, m = F.floor(a), (a - F.floor(a)) * 60
    up = fixed(m, 4).cast("double") >= 60
    d, m = F.when(up, d + 1).otherwise(d), F.when(up, 0.0).otherwise(m)
    return F.struct(F.concat(F.when(col(v) < 0, "-").otherwise(""), d.cast("string")).alias("d"), fixed(m, 4).alias("m"))


def utm_text(lat, lon) -> Column:
    east, north = utm_forward(lat, lon)
    return F.concat(utm_zone(lon).cast("string"), utm_band(lat), F.lit(" "), js_round(east).cast("string"), F.lit(" "), js_round(north).cast("string"))


def hemi_dd(v, is_lat: bool) -> Column:
    a = F.abs(col(v))
    return F.concat(hemisphere(v, is_lat), F.lit(" "), F.format_string("%09.6f" if is_lat else "%010.6f", a))


def edit_lines(lat, lon, fmt) -> Column:
    """The position in the format in which it was read, one line an axis."""
    f = F.coalesce(col(fmt), F.lit(""))
    utm = F.split(utm_text(lat, lon), " ")
    return (
        F.when(f.contains("UTM"), F.array(utm[0], pad_left(utm[1], 7), pad_left(utm[2], 7)))
        .when(f.contains("DMS"), F.array(dms_text(lat, True), dms_text(lon, False)))
        .when(f.contains("DMM") | f.contains("NMEA"), F.array(dmm_text(lat, True), dmm_text(lon, False)))
        .otherwise(F.array(hemi_dd(lat, True), hemi_dd(lon, False)))
    )


def xml_escape(x) -> Column:
    out = col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_unescape(x) -> Column:
    out = col(x)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def uri_component(x) -> Column:
    """Percent-encoding that leaves ! ' ( ) ~ as they are and writes blanks as %20."""
    out = F.replace(F.url_encode(col(x)), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def uri_decode(x) -> Column:
    """Percent-decoding; text with a broken or non-UTF-8 escape stays raw."""
    x = col(x)
    decoded = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return F.when(x.rlike("%(?![0-9A-Fa-f]{2})") | decoded.contains("�"), x).otherwise(F.coalesce(decoded, x))


def place_phrase(distance, bearing) -> Column:
    return F.when(col(distance) < 50, "sur place").otherwise(F.concat(F.lit("point à "), distance_text(distance), F.lit(" au "), cardinal(bearing)))


def municipality_text(name, department, country) -> Column:
    extra = F.coalesce(F.nullif(col(department), F.lit("")), F.nullif(col(country), F.lit("")))
    return F.concat(col(name), F.when(extra.isNotNull(), F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""))


def pin_label(ids) -> Column:
    """1-based numbers: one, a range, or a list."""
    n = F.transform(col(ids), lambda i: i + 1)
    row = F.forall(F.sequence(F.lit(1), F.size(n)), lambda k: F.element_at(n, k) == F.element_at(n, 1) + k - 1)
    text = F.transform(n, lambda i: i.cast("string"))
    return F.when(F.size(n) == 1, text[0]).when(row, F.concat(text[0], F.lit("-"), F.element_at(text, -1))).otherwise(F.array_join(text, ","))


def shot_key(name, size, modified) -> Column:
    return F.concat_ws("|", F.coalesce(F.nullif(col(name), F.lit("")), F.lit("photo")), F.coalesce(col(size), F.lit(0)).cast("string"), F.coalesce(col(modified), F.lit(0)).cast("string"))


def point_key(lat, lon) -> Column:
    """The cache key of a point: five decimals."""
    return F.concat(fixed(lat, 5), F.lit(","), fixed(lon, 5))


def links(lat, lon, name: str = "Point") -> Column:
    """struct(dd, route, map, geo) of a position."""
    pair = F.concat(degrees6(lat), F.lit(","), degrees6(lon))
    return F.struct(
        F.concat(degrees6(lat), F.lit(", "), degrees6(lon)).alias("dd"),
        F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), pair, F.lit("&travelmode=driving")).alias("route"),
        F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), pair).alias("map"),
        F.concat(F.lit("geo:"), pair, F.lit("?q="), pair, F.lit(f"({name})")).alias("geo"),
    )


def all_formats(lat, lon, title: str = "Point") -> Column:
    dd = F.concat(F.lit("DD : "), degrees6(lat), F.lit(", "), degrees6(lon))
    dmm = F.concat(F.lit("DMM : "), dmm_text(lat, True), F.lit(" "), dmm_text(lon, False))
    dms = F.concat(F.lit("DMS : "), dms_text(lat, True), F.lit(" "), dms_text(lon, False))
    return F.concat_ws("\n", F.lit(title), dd, dmm, dms, F.concat(F.lit("UTM : "), utm_text(lat, lon)))


def share_message(lat, lon, place=None, title: str = "Point") -> Column:
    dmm = F.concat(F.lit("DMM : "), dmm_text(lat, True), F.lit(" "), dmm_text(lon, False))
    return F.concat_ws("\n", F.lit(title), links(lat, lon)["dd"], dmm, col(place) if place is not None else F.lit(None).cast("string"), F.concat(F.lit("Carte : "), links(lat, lon)["map"]))
