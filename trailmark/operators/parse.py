"""Positions in noisy text: normalise, tokenise, enumerate windows, score, choose.

The parse of any text is one Arrow-batched function that stays inside its stage: no
shuffle, no explode. It is the reference of ``parse_columns``, which gives the same
results in column expressions wherever Unicode's compatibility forms (NFKC, which
Spark lacks) leave a text alone.

Work a text is linear in its tokens: windows hold ten tokens and six numbers at
most. Candidates are numbered in the order of their making, which breaks ties.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trailmark import constants as C

A = re.ASCII
# Fixed values that decide results: look-alikes of the unit symbols, keywords without meaning, names of
# hemispheres, and the patterns of repairs (in order), tokens and UTM texts.
APOSTROPHES, QUOTES, DEGREES = "′’‘´`ʹʼ", "″“”ʺ", "º˚ᵒ⁰°"
SKIPPED = frozenset("lat latitude lon lng long longitude position pos gps coord coordonnée coordonnee coordonnées coordonnees wgs wgs84 point".split())
HEMISPHERES = {"nord": "N", "north": "N", "sud": "S", "south": "S", "est": "E", "east": "E", "ouest": "W", "west": "W", "n": "N", "s": "S", "e": "E", "w": "W", "o": "O"}
NEUTRAL = frozenset(",;/ \t\r\n\v\f:()[]=@&?#+_|!.~*-")
BLANKS = re.compile("[\u1680\u2028\u2029\ufeff]")  # white space that NFKC leaves and an ASCII pattern misses
STEPS = [
    (re.compile(f"[{APOSTROPHES}]"), "'"),
    (re.compile(f"[{QUOTES}]"), '"'),
    (re.compile("''"), '"'),
    (re.compile(f"[{DEGREES}]"), "°"),
    (re.compile(r"\bdeg(?:r[eéÉ]s?)?\b", re.I | A), "°"),
    (re.compile(r"(\d)\s*\*", A), r"\1°"),
    (re.compile(r"(^|[^A-Za-z0-9.,])([oO]{1,2})(?=\d)", A), lambda m: m[1] + "0" * len(m[2])),
    (re.compile(r"(^|[^\d.,])(\d{1,3})[oO](?=\s?\d{1,2}(?:[.,][\dOo]|\s*'|\s+\d))", A), r"\1\2°"),
]
MISREAD = [
    (re.compile(r"(\d)[oO](?=[\d.,°'\"])", A), r"\g<1>0"),
    (re.compile(r"([\d.,])[oO](?=\d)", A), r"\g<1>0"),
    (re.compile(r"(\d)[lI|](?=[\d.,])", A), r"\g<1>1"),
    (re.compile(r"([\d.,])[lI|](?=\d)", A), r"\g<1>1"),
]
#: Numbers of texts with a decimal point, where commas separate; and of others, where they may be decimal.
LEXERS = {
    point: re.compile(rf"(?P<neg>-?)(?P<num>\d+(?:{mark}\d+)?)|(?P<sym>[°'\"])|(?P<word>[A-Za-zÀ-ÿ]+)|(?P<other>\S)", A)
    for point, mark in ((True, r"\."), (False, "[.,]"))
}
UTM = re.compile(r"(?:^|[^\dA-Za-z])(\d{1,2})\s?([C-HJ-NP-X])(?![A-Za-z])\s*(?:E\s*:?\s*)?(\d{6,7})(?:[.,]\d+)?\s*(?:m\b\s*)?(?:E\b\s*)?(?:N\s*:?\s*)?(\d{7})(?:[.,]\d+)?", A)


@dataclass(slots=True)
class Token:
    kind: str  # num, hemi, word
    start: int
    end: int
    line: int
    text: str = ""
    negative: bool = False
    symbol: str = ""


@dataclass(slots=True)
class Candidate:
    lat: float
    lon: float
    fmt: str
    score: float
    notes: list = field(default_factory=list)
    start: int = 0
    end: int = 0
    hemi: bool = False


def normalise(text: str) -> str:
    out = BLANKS.sub(" ", unicodedata.normalize("NFKC", text))
    for pattern, by in STEPS:
        out = pattern.sub(by, out)
    for _ in range(3):  # one repair may make room for another beside it
        for pattern, by in MISREAD:
            out = pattern.sub(by, out)
    return out


def tokens(norm: str) -> list[Token]:
    point = re.search(r"\d\.\d", norm, A) is not None
    out: list[Token] = []
    last: Token | None = None  # what a symbol may attach to
    line, seen = 0, 0
    for m in LEXERS[point].finditer(norm):
        line += norm.count("\n", seen, m.start())
        seen = m.start()
        if m["num"] is not None:
            last = Token("num", m.start(), m.end(), line, m["num"].replace(",", "."), bool(m["neg"]))
            out.append(last)
        elif m["sym"]:
            if last is not None and last.kind == "num" and not last.symbol:
                last.symbol, last.end = m["sym"], m.end()
            # what follows may not attach to the number behind a symbol
            last = None
        elif m["word"]:
            word = m["word"].lower()
            if word in HEMISPHERES:
                last = Token("hemi", m.start(), m.end(), line, HEMISPHERES[word])
                out.append(last)
            elif word not in SKIPPED:
                last = Token("word", m.start(), m.end(), line)
                out.append(last)
        elif m["other"] not in NEUTRAL:
            last = Token("word", m.start(), m.end(), line)
            out.append(last)
    return out


def runs(found: list[Token]) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in found:
        if t.kind == "word":
            out.append([])
        else:
            out[-1].append(t)
    return [r for r in out if r]


def readings(group: list[Token], most: float) -> list[tuple[float, str, float, str | None]]:
    """(value, format, penalty, doubt) of one to three numbers on an axis."""
    v = [float(t.text) for t in group]
    whole = ["." not in t.text for t in group]
    decimals = [0 if w else len(t.text.split(".")[1]) for t, w in zip(group, whole)]
    out = []
    if len(group) == 1:
        t, head = group[0], group[0].text.split(".")[0]
        tail = group[0].text[len(head) :]
        if v[0] <= most and t.symbol not in ("'", '"'):
            if decimals[0] >= 3:
                out.append((v[0], "DD", 0.0, None))
            elif decimals[0]:
                out.append((v[0], "DD", C.DD_SHORT, "few_decimals"))
            else:
                out.append((v[0], "DD", C.DD_INTEGER, "whole_degrees"))
        glued = float(head[-2:] + tail) if len(head) >= 3 else 60.0
        if len(head) >= 3 and not t.symbol and int(head[:-2]) <= most and glued < 60:
            out.append((int(head[:-2]) + glued / 60, "NMEA", C.NMEA, "glued"))
        if len(head) >= 4 and head[-3] == "0" and int(head[:-3]) <= most and glued < 60:
            out.append((int(head[:-3]) + glued / 60, "DMM", C.DEGREE_AS_ZERO, "degree_as_zero"))
    elif len(group) == 2 and whole[0] and v[0] <= most and v[1] < 60:
        doubts = []
        if group[0].symbol == "'":
            doubts.append("symbol_degree")
        if group[1].symbol == '"' and not (group[0].symbol == "°" and decimals[1] >= 3):
            doubts.append("symbol_minutes")
        if decimals[1] < 3:
            doubts.append("short_minutes")
        out.append((v[0] + v[1] / 60, "DMM", C.DMM_FIX * len(doubts), ",".join(doubts) or None))
    elif len(group) == 3 and whole[0] and whole[1] and v[0] <= most and v[1] < 60 and v[2] < 60:
        out.append((v[0] + v[1] / 60 + v[2] / 3600, "DMS", 0.0, None))
    sign = -1 if group[0].negative else 1
    return [(sign * x, *rest) for x, *rest in out]


def halves(numbers: list[Token]) -> list[int]:
    """Where numbers without hemispheres may be cut in two."""
    at = [i for i, t in enumerate(numbers) if t.symbol == "°"]
    cuts = [at[1]] if len(at) == 2 and at[0] == 0 else []
    if len(numbers) % 2 == 0 and len(numbers) // 2 not in cuts:
        cuts.append(len(numbers) // 2)
    return cuts


def in_box(box: tuple, lat: float, lon: float) -> bool:
    return box[0] <= lat <= box[1] and box[2] <= lon <= box[3]


def in_region(lat: float, lon: float) -> bool:
    return in_box(C.ALPS, lat, lon) or in_box(C.FRANCE, lat, lon)


def region_score(lat: float, lon: float) -> float:
    return C.IN_ALPS if in_box(C.ALPS, lat, lon) else C.IN_FRANCE if in_box(C.FRANCE, lat, lon) else 0.0


def split_window(window: list[Token], before: Token | None, after: Token | None) -> Iterator[tuple[list, list, str, str]]:
    """Groups of numbers and their hemispheres ('' without), in the order of the text."""
    hemis = [i for i, t in enumerate(window) if t.kind == "hemi"]
    numbers = [t for t in window if t.kind == "num"]
    if not 2 <= len(numbers) <= 6 or len(hemis) not in (0, 2):
        return
    if not hemis:
        for k in halves(numbers):
            yield numbers[:k], numbers[k:], "", ""
        return
    i, j = hemis
    if i == 0:  # letters ahead of their numbers; the window must not cut the last group
        if after is not None and after.kind == "num" and after.line == window[-1].line:
            return
        groups = window[1:j], window[j + 1 :]
    elif j == len(window) - 1:
        if before is not None and before.kind == "num" and before.line == window[0].line:
            return
        groups = window[:i], window[i + 1 : j]
    else:
        return
    if groups[0] and groups[1]:
        yield groups[0], groups[1], window[i].text, window[j].text


def window_candidates(window: list[Token], before: Token | None, after: Token | None, spare: int) -> Iterator[Candidate]:
    for a, b, ha, hb in split_window(window, before, after):
        if ha:
            if (ha in "NS") == (hb in "NS"):
                continue
            orders = [(a, b, ha, hb, False)] if ha in "NS" else [(b, a, hb, ha, False)]
        else:
            orders = [(a, b, "", "", False), (b, a, "", "", True)]
        for la_group, lo_group, la_hemi, lo_hemi, swapped in orders:
            symbols = sum(bool(t.symbol) for t in (*la_group, *lo_group))
            los = readings(lo_group, 180)
            for lat, la_fmt, la_pen, la_doubt in readings(la_group, 90):
                for lon, lo_fmt, lo_pen, lo_doubt in los:
                    y = -abs(lat) if la_hemi == "S" else lat
                    x = -abs(lon) if lo_hemi in ("W", "O") else lon
                    same, region = la_fmt == lo_fmt, region_score(y, x)
                    score = (C.HEMI if ha else 0.0) + min(C.SYMBOL_MOST, symbols) * C.SYMBOL + (C.SAME_FORMAT if same else 0.0) - (la_pen + lo_pen) + region - (C.SWAPPED if swapped else 0.0) - spare * C.UNUSED
                    marks = [(not region, "outside"), (swapped, "swapped"), (la_doubt, f"lat:{la_doubt}"), (lo_doubt, f"lon:{lo_doubt}"), (x < 0 and ha, "west"), (not same, "mixed_formats")]
                    yield Candidate(y, x, la_fmt if same else f"{la_fmt} / {lo_fmt}", score, [name for on, name in marks if on], window[0].start, window[-1].end, bool(ha))


def utm_to_latlon(zone: int, band: str, easting: float, northing: float) -> tuple[float, float]:
    """Inverse transverse Mercator by its usual series."""
    e2 = C.WGS84_F * (2 - C.WGS84_F)
    ep2 = e2 / (1 - e2)
    y = northing - (10_000_000 if band < "N" else 0)
    mu = y / C.UTM_K0 / (C.WGS84_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    n = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    foot = mu + sum(k * math.sin(i * mu) for i, k in ((2, 3 * n / 2 - 27 * n**3 / 32), (4, 21 * n**2 / 16 - 55 * n**4 / 32), (6, 151 * n**3 / 96), (8, 1097 * n**4 / 512)))
    s, c, t = math.sin(foot), math.cos(foot), math.tan(foot)
    q = 1 - e2 * s * s
    t2, c2, d = t * t, ep2 * c * c, (easting - 500_000) * math.sqrt(q) / (C.WGS84_A * C.UTM_K0)
    fall = d**2 / 2 - (5 + 3 * t2 + 10 * c2 - 4 * c2**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t2 + 298 * c2 + 45 * t2**2 - 252 * ep2 - 3 * c2**2) * d**6 / 720
    side = d - (1 + 2 * t2 + c2) * d**3 / 6 + (5 - 2 * c2 + 28 * t2 - 3 * c2**2 + 8 * ep2 + 24 * t2**2) * d**5 / 120
    return math.degrees(foot - t * q / (1 - e2) * fall), zone * 6 - 183 + math.degrees(side / c)


def utm_candidates(norm: str) -> Iterator[Candidate]:
    for m in UTM.finditer(norm):
        zone = int(m[1])
        if not 1 <= zone <= 60:
            continue
        lat, lon = utm_to_latlon(zone, m[2], float(m[3]), float(m[4]))
        if 180 < abs(lon) <= 180 + C.DATE_LINE_SLACK:  # rounded metres may lie a little beyond the date line
            lon -= math.copysign(360, lon)
        if abs(lat) <= 84:
            region = region_score(lat, lon)
            yield Candidate(lat, lon, f"UTM {zone}{m[2]}", C.UTM_BASE + region, [] if region else ["outside_utm"], m.start(1), m.end(), True)


def distance_m(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * C.SPHERE_M * math.asin(min(1.0, math.sqrt(h)))


def candidates(norm: str) -> list[Candidate]:
    """All candidates on the globe, in the order of their making."""
    out = list(utm_candidates(norm))
    for run in runs(tokens(norm)):
        counts = [0]
        for t in run:
            counts.append(counts[-1] + (t.kind == "num"))
        for i in range(len(run)):
            for j in range(i + 2, min(i + 10, len(run)) + 1):
                inside = counts[j] - counts[i]
                if inside > 6:
                    break
                if inside >= 2:
                    out += window_candidates(run[i:j], run[i - 1] if i else None, run[j] if j < len(run) else None, counts[-1] - inside)
    return [c for c in out if abs(c.lat) <= 90 and abs(c.lon) <= 180 and (c.lat, c.lon) != (0, 0)]


@lru_cache(maxsize=4096)
def parse(text: str | None) -> dict:
    """ok, empty, norm, conf, best and up to two alternatives."""
    if text is None or not text.strip():
        return {"ok": False, "empty": True, "norm": None, "conf": None, "best": None, "alts": []}
    norm = normalise(text)
    found = sorted(candidates(norm), key=lambda c: -c.score)  # stable: ties stay in order
    if not found:
        return {"ok": False, "empty": False, "norm": norm, "conf": None, "best": None, "alts": []}
    best, kept = found[0], []
    for c in found[1:]:
        if c.score < best.score - C.ALT_GAP:
            break
        if all(distance_m((c.lat, c.lon), (x.lat, x.lon)) > C.ALT_METRES for x in (best, *kept)):
            kept.append(c)
    row = lambda c: {"lat": c.lat, "lon": c.lon, "fmt": c.fmt, "score": c.score, "notes": list(c.notes), "hemi": c.hemi, "seg": re.sub(r"\s+", " ", norm[c.start : c.end]).strip()}
    return {"ok": True, "empty": False, "norm": norm, "conf": "check" if best.notes or kept else "ok", "best": row(best), "alts": [row(c) for c in kept[:2]]}


CANDIDATE = "struct<lat:double,lon:double,fmt:string,score:double,notes:array<string>,hemi:boolean,seg:string>"
RESULT = f"struct<ok:boolean,empty:boolean,norm:string,conf:string,best:{CANDIDATE},alts:array<{CANDIDATE}>>"


def _normalised(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalise(t))


TOKENS = "array<struct<kind:string,start:int,end:int,line:int,text:string,negative:boolean,symbol:string,run:int>>"


def _token_rows(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        out, run = [], 0
        for t in tokens(normalise(text)):
            run += t.kind == "word"
            out.append({"kind": t.kind, "start": t.start, "end": t.end, "line": t.line, "text": t.text, "negative": t.negative, "symbol": t.symbol, "run": run})
        return out

    return texts.map(one)


def parse_position(text: Column | str) -> Column:
    """The parse of a text column as a struct; texts of a batch that differ in digits only are parsed side by side."""

    @F.arrow_udf(RESULT)
    def parsed(texts: pa.Array) -> pa.Array:
        from trailmark.operators.parse_batch import parse_array

        return parse_array(texts)

    return parsed(text)


def normalised(text: Column | str) -> Column:
    return F.pandas_udf(_normalised, "string")(text)


def token_rows(text: Column | str) -> Column:
    """The tokens of a text, each with the number of its run."""
    return F.pandas_udf(_token_rows, TOKENS)(text)


def parse_positions(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the parse of a column, one row a text."""
    return df.withColumn("p", parse_position(text))


def parse_once(df: DataFrame, text: str = "text", parser: Callable[[Column], Column] = parse_position, rows: Callable | None = None) -> DataFrame:
    """``parse_positions`` where texts repeat: distinct texts are parsed and joined back.

    ``rows``, of a table, its column and a parser, parses them otherwise than one by one (``parse_shapes``).
    ``df`` is read twice. Where no text repeats this costs two exchanges more than ``parse_positions``.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(text).alias("text_once")).distinct().repartition(tasks, "text_once")
    # a generator is evaluated where it stands: of a plain column, filters on ``p`` would be copies that parse again
    once = rows(texts, "text_once", parser) if rows else texts.select("text_once", F.explode(F.array(parser(F.col("text_once")))).alias("p"))
    once = once.hint("merge")
    return df.join(once, F.col(text).eqNullSafe(F.col("text_once")), "left").drop("text_once")


def all_positions(df: DataFrame, text: str = "text", parser: Callable[[Column], Column] = parse_position, rows: Callable | None = None) -> DataFrame:
    """One row a position: the best of each text (rank 0), then its alternatives."""
    found = parse_once(df, text, parser, rows).where("p.ok")
    return found.select(*df.columns, F.posexplode(F.concat(F.array("p.best"), "p.alts")).alias("rank", "c")).select(*df.columns, "rank", "c.*")


def preview_edits(edits: DataFrame, parser: Callable[[Column], Column] = parse_position) -> DataFrame:
    """What an edit of one character gives: accepted, position and metres moved.

    edits: id, text, at (1-based), char, lat, lon (the position before). An edit is
    accepted if the text still reads as one position without alternatives.
    """
    from trailmark.functions.geo import haversine_m

    rows = edits.withColumn("edited", F.overlay("text", "char", F.col("at"), F.lit(1)))
    rows = parse_positions(rows, "edited") if parser is parse_position else parse_once(rows, "edited", parser)
    ok = F.col("p.ok") & (F.size("p.alts") == 0)
    return rows.select("id", "edited", ok.alias("accepted"), F.when(ok, F.col("p.best.lat")).alias("lat"), F.when(ok, F.col("p.best.lon")).alias("lon"), F.when(ok, haversine_m("lat", "lon", "p.best.lat", "p.best.lon")).alias("moved"))
