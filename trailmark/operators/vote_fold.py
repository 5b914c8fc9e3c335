"""The fold of ``vote`` over many photos at once: each step casts one vote of every photo of a batch.

Arrow hands over sorted readings; steps are numpy over photos, so a photo costs its votes and
nothing an interpreter does a reading. Photos of about equal length share a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from trailmark import constants as C
from trailmark.operators.parse import parse

GROUP = "struct<v:double,w:double,n:int,runs:array<int>>"
GROUPS = ("lat_best", "lat_second", "lon_best", "lon_second")
#: The pass, whether it votes, its weight and values, the number of its notes and its confidence.
FIELDS = ("idx", "on", "w", "lat", "lon", "n_notes", "tess_")
ROWS, CELLS = 1 << 16, 1 << 17  # readings of a table of rows; places of a table of photos by readings
Kernel = Callable[[pa.Table, np.ndarray], pa.Table]
_GROUP = pa.struct([("v", pa.float64()), ("w", pa.float64()), ("n", pa.int32()), ("runs", pa.list_(pa.int32()))])


class Groups:
    """Vote groups of one axis of many photos: value, weight and size of each; and of each vote its group.

    A vote that brings a value into a group opens a slot there: ``home`` is the slot's group, ``held`` the value's weight.
    """

    def __init__(self, photos: int, steps: int):
        self.v, self.w, self.n = np.zeros((photos, steps)), np.full((photos, steps), -np.inf), np.zeros((photos, steps), np.int32)
        self.made, self.of = np.zeros(photos, np.int64), np.full((photos, steps), -1, np.int32)
        self.home, self.held = np.full((photos, steps), -1, np.int32), np.zeros((photos, steps))

    def cast(self, rows: np.ndarray, t: int, v: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
        """Vote ``t`` of ``rows``: it joins the first group that is near, or makes one. x: values to six decimals, of all steps."""
        near = (np.abs(self.v[rows, : t + 1] - v[rows, t, None]) < C.VOTE_TOLERANCE) & (np.arange(t + 1) < self.made[rows, None])
        joins = near.any(axis=1)
        at = np.where(joins, near.argmax(axis=1), self.made[rows])
        self.made[rows] += ~joins
        xs, weight = x[rows, : t + 1], w[rows, t]
        bits = xs.view(np.int64)
        same = (self.home[rows, : t + 1] == at[:, None]) & (bits == bits[:, t, None])
        slot = np.where(same.any(axis=1), same.argmax(axis=1), t)
        self.home[rows, slot] = at
        self.held[rows, slot] += weight
        own = np.where(self.home[rows, : t + 1] == at[:, None], self.held[rows, : t + 1], -1.0)
        self.v[rows, at] = xs[np.arange(len(rows)), own.argmax(axis=1)]
        self.w[rows, at] = np.where(joins, self.w[rows, at] + weight, weight)
        self.n[rows, at] += 1
        self.of[rows, t] = at

    def leaders(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The heaviest group and the next, the first made of equals; -1 for none."""
        w, each = self.w[rows].copy(), np.arange(len(rows))
        best = w.argmax(axis=1)
        w[each, best] = -np.inf
        return np.where(self.made[rows] > 0, best, -1), np.where(self.made[rows] > 1, w.argmax(axis=1), -1)

    def firm(self, rows: np.ndarray) -> np.ndarray:
        best, second = self.leaders(rows)
        n = self.n[rows, best]
        return (best >= 0) & (n >= C.VOTE_NEED) & ((second < 0) | (self.n[rows, second] <= n - C.VOTE_MARGIN))


def six(v: np.ndarray) -> np.ndarray:
    """Values to six decimals, halves away from zero as decimals are written."""
    scaled = v * 1e6
    out = np.rint(scaled) / 1e6
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-3):
        out.flat[i] = float(Decimal(repr(float(v.flat[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _chunks(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """Photos of about equal length: their numbers, which places hold a reading, and the fields as tables (photos, readings)."""
    size = np.diff(np.append(starts, rows.num_rows))
    flat = {}
    for k in FIELDS:
        a = rows.column(k).combine_chunks()
        flat |= {k: a.fill_null(False if pa.types.is_boolean(a.type) else 0).to_numpy(zero_copy_only=False), f"{k}?": a.is_valid().to_numpy(zero_copy_only=False)}
    flat |= {f"{k}x": six(flat[k]) for k in ("lat", "lon")}
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = len(order)
        while j - i > 1 and (j - i) * int(size[order[j - 1]]) > CELLS:
            j = i + (j - i) // 2
        photos = order[i:j]
        places = np.arange(int(size[photos[-1]]))
        inside = places < size[photos][:, None]
        at = np.where(inside, starts[photos][:, None] + places, 0)
        yield photos, inside, {k: np.where(inside, a[at], 0).astype(a.dtype) for k, a in flat.items()}
        i = j


def _fold(d: dict, axis: str) -> tuple[Groups, np.ndarray]:
    """The groups of an axis, and the passes in the order of the votes."""
    on = d["on"].astype(bool)
    order = np.lexsort((d["w"], d[axis], d["idx"], ~on))  # those that count first, by pass
    take = lambda a: np.take_along_axis(a, order, axis=1)
    v, x, w, n = take(d[axis]), np.ascontiguousarray(take(d[f"{axis}x"])), take(d["w"]), on.sum(axis=1)
    groups = Groups(*on.shape)
    for t in range(int(n.max(initial=0))):
        groups.cast(np.flatnonzero(n > t), t, v, x, w)
    return groups, take(d["idx"]).astype(np.int32)


def _group_rows(g: Groups, idx: np.ndarray, which: np.ndarray) -> tuple:
    rows = np.arange(len(which))
    member = (g.of == which[:, None]) & (which >= 0)[:, None]
    return which >= 0, g.v[rows, which], g.w[rows, which], g.n[rows, which], member.sum(axis=1), idx[member]


def _in_runs(idx: np.ndarray, passes: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Which readings have the pass of a member vote."""
    out = np.zeros(idx.shape, bool)
    for t in range(idx.shape[1]):
        out |= member[:, t, None] & (idx == passes[:, t, None])
    return out


def axes(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """One row a photo: its groups, ``ref`` (the row that holds both winning values, with the fewest notes) and ``heard`` (mean ``tess`` of the winners' readings)."""
    parts: dict = {k: [] for k in GROUPS}
    photos_of, refs, heards = [], [], []
    for photos, inside, d in _chunks(rows, starts):
        runs, best = {}, {}
        for axis in ("lat", "lon"):
            g, idx = _fold(d, axis)
            first, second = g.leaders(np.arange(len(photos)))
            parts[f"{axis}_best"].append(_group_rows(g, idx, first))
            parts[f"{axis}_second"].append(_group_rows(g, idx, second))
            runs[axis] = inside & _in_runs(d["idx"], idx, (g.of == first[:, None]) & (first >= 0)[:, None])
            best[axis] = np.ascontiguousarray(g.v[np.arange(len(photos)), first])
        both = runs["lat"] & runs["lon"]
        apart = lambda axis: np.where(d[f"{axis}?"] & (np.ascontiguousarray(d[f"{axis}x"]).view(np.int64) == best[axis].view(np.int64)[:, None]), 0, 10)
        # readings are sorted by pass: the first of the least rank
        rank = np.where(both, apart("lat") + apart("lon") + d["n_notes"], np.iinfo(np.int64).max)
        refs.append(np.where(both.any(axis=1), starts[photos] + rank.argmin(axis=1), -1))
        heard = (runs["lat"] | runs["lon"]) & d["tess_?"]
        total = np.zeros(len(photos))
        for t in range(inside.shape[1]):
            total = np.where(heard[:, t], total + d["tess_"][:, t], total)
        count = heard.sum(axis=1)
        heards.append(np.ma.array(total / np.maximum(count, 1), mask=count == 0))
        photos_of.append(photos)
    back = pa.array(np.argsort(np.concatenate(photos_of)))

    def group(pieces: list) -> pa.Array:
        has, v, w, n, sizes, passes = (np.concatenate(p) for p in zip(*pieces))
        lists_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(passes))
        return pa.StructArray.from_arrays([pa.array(v), pa.array(w), pa.array(n.astype(np.int32)), lists_], fields=list(_GROUP), mask=pa.array(~has))

    ref, heard = np.concatenate(refs), np.ma.concatenate(heards)
    out = {**{k: group(parts[k]) for k in GROUPS}, "ref": pa.array(ref, mask=ref < 0), "heard": pa.array(heard.data, mask=np.ma.getmaskarray(heard))}
    return pa.table(out).take(back)


def _written(chosen: pa.StructArray, made: pa.Table) -> tuple[pa.StructArray, pa.Array]:
    """``chosen`` with the parse of both winning values where no reading holds them, and where that is."""
    lat, lon = (made.column(f"{a}_best").combine_chunks() for a in ("lat", "lon"))
    apart = pc.and_(chosen.is_null(), pc.and_(lat.is_valid(), lon.is_valid()))
    at = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
    if not len(at):
        return chosen, apart
    texts = ["%.6f, %.6f" % (y, x) for y, x in zip(lat.field("v").take(pa.array(at)).to_pylist(), lon.field("v").take(pa.array(at)).to_pylist())]
    found = [(t, parse(t)) for t in texts]
    short = lambda p: {k: p["best"][k] for k in ("lat", "lon", "fmt", "notes")} | {"alts": [{k: a[k] for k in ("lat", "lon")} for a in p["alts"]]} if p["ok"] else {}
    extra = pa.array([{"txt": t, "ok": p["ok"], **short(p)} for t, p in found], type=chosen.type)
    place = np.arange(len(chosen))
    place[at] = len(chosen) + np.arange(len(at))
    return pa.concat_arrays([chosen, extra]).take(pa.array(place)), apart


def settled(keys: tuple[str, ...], own: list[str]) -> Kernel:
    """keys, total, groups, heard, first (text of the first reading), ref (the chosen reading, or both values ``apart`` written out and parsed)."""

    def kernel(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        made = axes(rows, starts).combine_chunks()
        at, ref = pa.array(starts), made.column("ref").combine_chunks()
        out = {k: rows.column(k).take(at) for k in keys} | {"total": pa.array(np.diff(np.append(starts, rows.num_rows)))}
        out |= {k: made.column(k) for k in (*GROUPS, "heard")}
        if own:
            picked = [rows.column(c).take(ref).combine_chunks() for c in own]
            chosen, apart = _written(pa.StructArray.from_arrays(picked, names=own, mask=ref.is_null()), made)
            out |= {"first": rows.column("txt").take(at), "ref": chosen, "apart": apart}
        return pa.table(out)

    return kernel


def kept(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """The readings up to the one after which the votes of both axes are firm; all where they never are."""
    stop = np.full(len(starts), np.iinfo(np.int64).max)
    for photos, _, d in _chunks(rows, starts):
        on = d["on"].astype(bool)
        order = np.argsort(~on, axis=1, kind="stable")
        votes = {k: np.take_along_axis(d[k], order, axis=1) for k in ("lat", "latx", "lon", "lonx", "w", "idx")}
        n = on.sum(axis=1)
        lat, lon = Groups(*on.shape), Groups(*on.shape)
        open_ = np.flatnonzero(n > 0)
        for t in range(int(n.max(initial=0))):
            open_ = open_[n[open_] > t]
            lat.cast(open_, t, votes["lat"], votes["latx"], votes["w"])
            lon.cast(open_, t, votes["lon"], votes["lonx"], votes["w"])
            firm = lat.firm(open_) & lon.firm(open_)
            stop[photos[open_[firm]]] = votes["idx"][open_[firm], t]
            open_ = open_[~firm]
    last = np.repeat(stop, np.diff(np.append(starts, rows.num_rows)))
    return rows.filter(pa.array(rows.column("idx").to_numpy() <= last)).drop_columns([f for f in FIELDS if f not in ("lat", "lon")])


def _starts(rows: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where a photo's rows begin."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        a = rows.column(k).combine_chunks()
        here, before = a.slice(1), a.slice(0, len(a) - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.not_equal(here.is_null(), before.is_null()))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def by_photo(rows: DataFrame, keys: tuple[str, ...], order: list[str], kernel: Kernel, schema: StructType) -> DataFrame:
    """``kernel`` over whole photos: one exchange, a sort, and tables of some ``ROWS`` readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, most = [], 0, ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            table = pa.Table.from_batches(waiting)
            starts = _starts(table, keys)
            last = int(starts[-1])
            if last:
                yield from kernel(table.slice(0, last), starts[:-1]).combine_chunks().to_batches()
            waiting, n = table.slice(last).to_batches(), table.num_rows - last
            most = max(ROWS, 2 * n)
        if waiting:
            table = pa.Table.from_batches(waiting)
            yield from kernel(table, _starts(table, keys)).combine_chunks().to_batches()

    # by a hash of the keys: an exchange by the keys themselves is dropped above a join on them, whose own may be read in pieces once it turns into a broadcast
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
