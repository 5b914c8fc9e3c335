"""Running totals inside keys of any size, without a task that holds a whole key.

Rows are range-partitioned and sorted by key and order, so a key that is too large
for one task lies in several neighbouring ones. Each task computes the totals of its
own rows and writes them; one line a task (its first and last key, and the totals of
the last) tells what the first key of each task has to start with.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trailmark.llm.hashing import BASE, U
from trailmark.llm.shared import drop_stage, lean, stage

OWN = ("scan_block", "scan_lead", "scan_row")


def power(exponent: np.ndarray) -> np.ndarray:
    """BASE**exponent modulo 2**64."""
    out, base, left = np.ones(len(exponent), U), BASE, exponent.astype(U)
    with np.errstate(over="ignore"):
        while left.any():
            out[(left & U(1)) > 0] *= base
            base, left = base * base, left >> U(1)
    return out


def running(batches: Iterable[pa.RecordBatch], keys: Sequence[str], hashes: Sequence[str], sums: Sequence[str], tops: Sequence[str]) -> Iterable[pa.RecordBatch]:
    """Totals of one task's sorted rows; the columns that follow those given are named in ``scan``."""
    block, row, first, last, held = TaskContext.get().partitionId(), 0, None, None, {}
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        key = [np.asarray(b.column(k)) for k in keys]
        new = np.ones(n, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        head = tuple(int(k[0]) for k in key)
        first = head if first is None else first
        follows = head == last
        starts = np.flatnonzero(new)
        segment = np.cumsum(new) - 1
        inside = segment == 0 if follows else np.zeros(n, bool)
        depth = np.arange(n) - starts[segment] + 1 + np.where(inside, held.get("depth", 0), 0)
        values: dict[str, np.ndarray] = {"depth": depth}

        def total(name: str, term: np.ndarray) -> np.ndarray:
            whole = np.cumsum(term)
            base = (whole - term)[starts][segment]
            return whole - base + np.where(inside, held.get(name, term.dtype.type(0)), term.dtype.type(0))

        for name in hashes:
            term = np.asarray(b.column(name)).view(U) * power(depth)
            values[f"key_{name}"] = total(f"key_{name}", term)
            values[f"before_{name}"] = values[f"key_{name}"] - term
        for name in sums:
            values[f"sum_{name}"] = total(f"sum_{name}", np.asarray(b.column(name)))
        for name in tops:
            top = np.asarray(b.column(name))
            low, wide = top.min(), int(top.max()) - int(top.min()) + 1
            top = np.maximum.accumulate(top - low + segment * wide) - segment * wide + low
            values[f"top_{name}"] = np.where(inside, np.maximum(top, held.get(f"top_{name}", top)), top)
        last, held = tuple(int(k[-1]) for k in key), {name: v[-1] for name, v in values.items()}
        lead = np.all([k == f for k, f in zip(key, first)], axis=0)
        columns = [*b.columns, *(pa.array(v.view(np.int64)) for v in values.values()), pa.array(np.full(n, block), pa.int64()), pa.array(lead), pa.array(np.arange(row, row + n), pa.int64())]
        row += n
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *values, *OWN])


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, hashes: Sequence[str] = (), sums: Sequence[str] = (), tops: Sequence[str] = ()) -> DataFrame:
    """``df`` with running values of its rows in ``order`` inside ``keys`` (longs, not null).

    Adds ``depth`` (the row's number from 1), of each column h in ``hashes`` ``key_h`` and
    ``before_h`` (a fingerprint of the values up to the row, with and without it), of s in ``sums``
    ``sum_s``, and of t in ``tops`` ``top_t``, the highest value so far. All are longs.
    """
    spark = df.sparkSession
    made = ["depth", *(f"{p}_{h}" for h in hashes for p in ("key", "before")), *(f"sum_{s}" for s in sums), *(f"top_{t}" for t in tops)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(m, T.LongType()) for m in made), *(T.StructField(o, T.BooleanType() if o == "scan_lead" else T.LongType()) for o in OWN)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, keys), *order]
    given = tuple(keys), tuple(hashes), tuple(sums), tuple(tops)
    local = stage(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(lean(lambda batches: running(batches, *given)), schema), "scan")
    ends = local.groupBy("scan_block").agg(F.min_by(F.struct(*keys), "scan_row").alias("head"), F.max_by(F.struct(*keys, *made), "scan_row").alias("tail"))
    state, carries, given_columns = None, {}, df.columns
    for r in sorted(ends.collect(), key=lambda r: r.scan_block):  # a line a partition
        head, tail = tuple(r.head), tuple(r.tail[k] for k in keys)
        values = {m: r.tail[m] for m in made}
        if state and state[0] == head:
            carries[r.scan_block] = state[1]
            if tail == head:
                values = joined(state[1], values)
        state = tail, values

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            data = {m: np.asarray(b.column(m)).copy() for m in made}
            block, lead = np.asarray(b.column("scan_block")), np.asarray(b.column("scan_lead"))
            for i in np.unique(block[lead]).tolist():
                if i in carries:
                    rows = np.flatnonzero(lead & (block == i))
                    for m, v in joined(carries[i], {m: data[m][rows] for m in made}).items():
                        data[m][rows] = v
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in given_columns), *(pa.array(data[m], pa.int64()) for m in made)], [*given_columns, *made])

    out = local.mapInArrow(lean(finish), T.StructType(schema.fields[: -len(OWN)]))
    out._scanned = local
    return out


def joined(before: dict, after: dict) -> dict:
    """Values of rows that follow others of their key; ``after`` may hold arrays."""
    shift = power(np.array([before["depth"]]))[0]
    out = {}
    for name, v in after.items():
        a = np.asarray(v, np.int64)
        if name.startswith("top_"):
            out[name] = np.maximum(a, before[name])
        elif name.startswith(("key_", "before_")):
            whole = before["key_" + name.split("_", 1)[1]]
            with np.errstate(over="ignore"):
                out[name] = (a.astype(U) * shift + np.int64(whole).astype(U)).astype(np.int64)
        else:
            out[name] = a + before[name]
        if np.ndim(v) == 0:
            out[name] = int(out[name])
    return out


def staged(scanned: DataFrame, name: str) -> DataFrame:
    """The result of a scan (or of columns taken from it) as a table; the scan's own table goes."""
    out = stage(scanned, name)
    drop_stage(getattr(scanned, "_scanned", None) or scanned)
    return out
