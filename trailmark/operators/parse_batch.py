"""The parser over a batch of texts: texts that differ in their digits only are parsed side by side.

Tokens, windows and groups of numbers follow from a text's shape (its digits all written as 9), so they are found
once a shape; what numbers decide (ranges, a zero before the minutes, regions, scores, distances) is numpy over the
texts of the shape. Results are those of ``parse.parse``, which takes shapes that few texts have, UTM texts and
numbers of more than fifteen digits.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trailmark import constants as C
from trailmark.operators import parse as P

LEAST, DIGITS = 4, 15
FIELDS = ("lat", "lon", "fmt", "score", "notes", "hemi", "seg")
_FOUND = pa.struct([("lat", pa.float64()), ("lon", pa.float64()), ("fmt", pa.string()), ("score", pa.float64()), ("notes", pa.list_(pa.string())), ("hemi", pa.bool_()), ("seg", pa.string())])
_TYPES = {"ok": pa.bool_(), "empty": pa.bool_(), "norm": pa.string(), "conf": pa.string(), "best": _FOUND, "alts": pa.list_(_FOUND)}


@lru_cache(maxsize=4096)
def _normal(shape: str) -> bool:
    """Whether normalisation leaves texts of this shape alone: its steps see digits, not which."""
    return P.normalise(shape) == shape


@lru_cache(maxsize=4096)
def _windows(shape: str) -> list | None:
    """(latitude group, longitude group, hemispheres, swapped, symbols, spare, start, end) of each way to read a shape, in the order of ``parse``."""
    found = P.tokens(shape)
    if P.UTM.search(shape) or any(t.kind == "num" and len(t.text) > DIGITS for t in found):
        return None
    out = []
    for run in P.runs(found):
        total = sum(t.kind == "num" for t in run)
        for i in range(len(run)):
            for j in range(i + 2, min(i + 10, len(run)) + 1):
                inside = sum(t.kind == "num" for t in run[i:j])
                if inside > 6:
                    break
                for a, b, ha, hb in P.split_window(run[i:j], run[i - 1] if i else None, run[j] if j < len(run) else None):
                    if ha and (ha in "NS") == (hb in "NS"):
                        continue
                    ways = [(a, b, "", "", False), (b, a, "", "", True)] if not ha else [(a, b, ha, hb, False)] if ha in "NS" else [(b, a, hb, ha, False)]
                    for la, lo, hla, hlo, swapped in ways:
                        out.append((la, lo, hla, hlo, swapped, sum(bool(t.symbol) for t in (*la, *lo)), total - inside, run[i].start, run[j - 1].end))
    return out


class _Numbers:
    """The numbers of texts of one shape, by their tokens."""

    def __init__(self, norms: list[str]):
        self.chars = np.array(norms).view(np.uint32).reshape(len(norms), -1)

    def value(self, digits: range, decimals: int = 0) -> np.ndarray:
        """The number that these characters write, as ``float`` reads it: both parts of the quotient are exact."""
        out = np.zeros(len(self.chars), np.int64)
        for k in digits:
            c = self.chars[:, k]
            out = np.where((c >= 48) & (c <= 57), out * 10 + c.astype(np.int64) - 48, out)  # the mark is skipped
        return out / 10.0**decimals

    def readings(self, group: list, most: float) -> list[tuple]:
        """``parse.readings``: value, whether it holds, format, penalty, doubt."""
        out, v, ends = [], [], []
        for t in group:
            head, _, tail = t.text.partition(".")
            start = t.start + t.negative
            v.append(self.value(range(start, start + len(t.text)), len(tail)))
            ends.append((start, len(head), len(tail)))
        whole = ["." not in t.text for t in group]
        if len(group) == 1:
            t, (start, n, decimals) = group[0], ends[0]
            if t.symbol not in ("'", '"'):
                pen, doubt = (0.0, None) if decimals >= 3 else (C.DD_SHORT, "few_decimals") if decimals else (C.DD_INTEGER, "whole_degrees")
                out.append((v[0], v[0] <= most, "DD", pen, doubt))
            if n >= 3:
                glued = self.value(range(start + n - 2, start + len(t.text)), decimals)
                if not t.symbol:
                    high = self.value(range(start, start + n - 2))
                    out.append((high + glued / 60, (high <= most) & (glued < 60), "NMEA", C.NMEA, "glued"))
                if n >= 4:
                    far = self.value(range(start, start + n - 3))
                    out.append((far + glued / 60, (self.chars[:, start + n - 3] == 48) & (far <= most) & (glued < 60), "DMM", C.DEGREE_AS_ZERO, "degree_as_zero"))
        elif len(group) == 2 and whole[0]:
            a, b = group
            on = [("symbol_degree", a.symbol == "'"), ("symbol_minutes", b.symbol == '"' and not (a.symbol == "°" and ends[1][2] >= 3)), ("short_minutes", ends[1][2] < 3)]
            doubts = [name for name, x in on if x]
            out.append((v[0] + v[1] / 60, (v[0] <= most) & (v[1] < 60), "DMM", C.DMM_FIX * len(doubts), ",".join(doubts) or None))
        elif len(group) == 3 and whole[0] and whole[1]:
            out.append((v[0] + v[1] / 60 + v[2] / 3600, (v[0] <= most) & (v[1] < 60) & (v[2] < 60), "DMS", 0.0, None))
        return [(-x, *rest) for x, *rest in out] if group[0].negative else out


def _far(lat, lon, y, x) -> np.ndarray:
    p, q = np.radians(lat), np.radians(y)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(x - lon) / 2) ** 2
    return 2 * C.SPHERE_M * np.arcsin(np.minimum(1.0, np.sqrt(h))) > C.ALT_METRES


def _in_box(b: tuple, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (y >= b[0]) & (y <= b[1]) & (x >= b[2]) & (x <= b[3])


def _of_shape(shape: str, norms: list[str], windows: list) -> tuple[list, list]:
    """(row, fields) pieces of the best candidates and of up to two others each."""
    numbers, known, made = _Numbers(norms), {}, []

    def readings(group, most):
        key = (tuple(t.start for t in group), most)
        if key not in known:
            known[key] = numbers.readings(group, most)
        return known[key]

    for la, lo, ha, hb, swapped, symbols, spare, start, end in windows:
        base = (C.HEMI if ha else 0.0) + min(C.SYMBOL_MOST, symbols) * C.SYMBOL
        for lat, lat_on, la_fmt, la_pen, la_doubt in readings(la, 90):
            for lon, lon_on, lo_fmt, lo_pen, lo_doubt in readings(lo, 180):
                y, x = -np.abs(lat) if ha == "S" else lat, -np.abs(lon) if hb in ("W", "O") else lon
                same = la_fmt == lo_fmt
                doubts = [f"lat:{la_doubt}"] * bool(la_doubt) + [f"lon:{lo_doubt}"] * bool(lo_doubt)
                made.append((y, x, lat_on & lon_on, base + (C.SAME_FORMAT if same else 0.0) - (la_pen + lo_pen), C.SWAPPED if swapped else 0.0, spare * C.UNUSED, la_fmt if same else f"{la_fmt} / {lo_fmt}", ["swapped"] * swapped + doubts, [] if same else ["mixed_formats"], bool(ha), start, end))
    if not made:
        return [], []
    y, x, on = (np.array([m[k] for m in made]) for k in range(3))
    col = lambda k: np.array([m[k] for m in made])[:, None]
    region = np.where(_in_box(C.ALPS, y, x), C.IN_ALPS, np.where(_in_box(C.FRANCE, y, x), C.IN_FRANCE, 0.0))
    score = col(3) + region - col(4) - col(5)
    score = np.where(on & (np.abs(y) <= 90) & (np.abs(x) <= 180) & ~((y == 0) & (x == 0)), score, -np.inf)
    each = np.arange(len(norms))

    def pieces(rows: np.ndarray, pick: np.ndarray) -> list:
        out = []
        for c in np.unique(pick):
            *_, fmt, front, back, hemi, start, end = made[c]
            r = rows[pick == c]
            kind = (region[c, r] == 0) * 2 + ((x[c, r] < 0) & hemi)
            notes = [["outside"] * (k // 2) + front + ["west"] * (k % 2) + back for k in range(4)]
            cut = shape[start:end]
            tidy = re.sub(r"\s+", " ", cut).strip() == cut
            segs = [norms[i][start:end] for i in r] if tidy else [re.sub(r"\s+", " ", norms[i][start:end]).strip() for i in r]
            out.append((r, y[c, r], x[c, r], fmt, score[c, r], [notes[k] for k in kind], hemi, segs))
        return out

    first = score.argmax(axis=0)
    top = score[first, each]
    has = np.flatnonzero(top > -np.inf)
    best, others = pieces(has, first[has]), []
    left = (score >= top - C.ALT_GAP) & (score > -np.inf)
    last = first
    for _ in range(2):
        left &= _far(y[last, each], x[last, each], y, x)
        order = np.where(left, score, -np.inf)
        last = order.argmax(axis=0)
        rows = np.flatnonzero(left.any(axis=0))
        if not len(rows):
            break
        others.append(pieces(rows, last[rows]))
        # rows without another have nothing left, whatever they are compared with
    return best, others


def _struct(cols: dict, at: np.ndarray | slice = slice(None)) -> list[pa.Array]:
    return [pa.array(cols[f][at], type=_FOUND.field(f).type) for f in FIELDS]


def _columns(n: int) -> dict:
    out = {f: np.empty(n, object) for f in ("fmt", "notes", "seg")}
    return out | {"lat": np.zeros(n), "lon": np.zeros(n), "score": np.zeros(n), "hemi": np.zeros(n, bool), "on": np.zeros(n, bool)}


def _put(cols: dict, rows: np.ndarray, piece: tuple) -> None:
    r, lat, lon, fmt, score, notes, hemi, segs = piece
    at = rows[r]
    for f, v in (("lat", lat), ("lon", lon), ("fmt", fmt), ("score", score), ("hemi", hemi), ("on", True)):
        cols[f][at] = v
    for i, a, b in zip(at.tolist(), notes, segs):
        cols["notes"][i], cols["seg"][i] = a, b


def _one(cols: dict, i: int, c: dict) -> None:
    for f in FIELDS:
        cols[f][i] = c[f]
    cols["on"][i] = True


def parse_distinct(texts: list[str]) -> pa.StructArray:
    """``parse.parse`` of each text."""
    n = len(texts)
    norm, empty, best, alts = np.empty(n, object), np.zeros(n, bool), _columns(n), [_columns(n), _columns(n)]
    shapes: dict[str, list[int]] = {}
    raw = pc.replace_substring_regex(pa.array(texts, pa.string()), "[0-9]", "9").to_pylist()
    for i, (t, s) in enumerate(zip(texts, raw)):
        if not t.strip():
            empty[i] = True
            continue
        if _normal(s):
            norm[i] = t
        else:
            norm[i] = P.normalise(t)
            s = re.sub("[0-9]", "9", norm[i])
        shapes.setdefault(s, []).append(i)
    more = np.zeros(n, bool)
    for s, rows in shapes.items():
        windows = _windows(s) if len(rows) >= LEAST else None
        if windows is None:
            for i in rows:
                p = P.parse(texts[i])
                if p["ok"]:
                    _one(best, i, p["best"])
                    more[i] = bool(p["alts"])
                    for k, c in enumerate(p["alts"]):
                        _one(alts[k], i, c)
            continue
        if not windows:
            continue
        at = np.array(rows)
        firsts, others = _of_shape(s, [norm[i] for i in rows], windows)
        for piece in firsts:
            _put(best, at, piece)
        for cols, pieces in zip(alts, others):
            for piece in pieces:
                _put(cols, at, piece)
                more[at[piece[0]]] = True
    ok = best["on"]
    conf = np.array([None if not o else "check" if m or b else "ok" for o, m, b in zip(ok.tolist(), more.tolist(), best["notes"])], dtype=object)
    found = pa.StructArray.from_arrays(_struct(best), fields=list(_FOUND), mask=pa.array(~ok))
    # the others of a text stand side by side
    both = [np.flatnonzero(a["on"]) for a in alts]
    order = np.argsort(np.concatenate(both), kind="stable")
    values = pa.concat_arrays([pa.StructArray.from_arrays(_struct(a, at), fields=list(_FOUND)) for a, at in zip(alts, both)]).take(pa.array(order))
    offsets = np.concatenate([[0], np.cumsum(alts[0]["on"].astype(np.int32) + alts[1]["on"])]).astype(np.int32)
    out = [pa.array(ok), pa.array(empty), pa.array(norm, type=pa.string()), pa.array(conf, type=pa.string()), found, pa.ListArray.from_arrays(pa.array(offsets), values)]
    return pa.StructArray.from_arrays(out, names=list(_TYPES))


def parse_array(texts: pa.Array) -> pa.StructArray:
    """``parse.parse`` of each text of a column; equal texts are parsed once."""
    coded = texts.fill_null("").dictionary_encode()
    return parse_distinct(coded.dictionary.to_pylist()).take(coded.indices)
