"""Exact top-k inner-product search through a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest
norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, so the largest product is the nearest
point. Each vector is keyed by its nearest pivot and its distance r to it, and
each pivot's vectors are cut into annuli of about equal counts.

A first look at a query's own annulus gives k products, the least of which
bounds the search radius R. A point can only be within R if its r lies within
R of the query's distance to that pivot (triangle inequality), so the search
expands over the sorted annuli that meet this interval and stops at the rest.

Pivots are fitted by a few k-means rounds on at most ``sample`` vectors (those
with the least hashes of their ids); every vector is indexed. What the driver
holds, and what is broadcast, is pivots and annuli: at most ``pivots`` times
``annuli`` lines for each dimension in the table. More pivots prune better, but a
pack of queries travels once to each ring that it may reach.

Scores are exact integers: floating point where products stay below 2**53, 64-bit
integers below 2**63, and Python's integers beyond. The search itself is in
floating point, with a slack that covers its rounding: sums of d squares err by
(d + 2) * 2**-53 of their size, so squared radii are widened by
(d + 8) * 2**-50 of |q|^2 + M^2, and distances by as much of |q| + 2M. Queries and vectors meet in
blocks; of equal vectors only the k + 1 smallest ids can be in any answer, so
only those are kept, however often a vector occurs.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part, and neither do empty ones or null ids; a vector with a component of 2**52
or more in size, whose integers do not fit 62 bits, raises ValueError, and so does an
answer whose score does not fit a long; rows with the same id and vector count once; other rows of a
query's id are not its candidates; vectors meet only those of their own length;
ties go to the smaller id; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailmark.llm.shared import stage, table

SCALE = 1024.0
LIMIT = 2**62
BLOCK, PACK = 2048, 256
CELL = ["dim", "pivot", "ring"]


@contextmanager
def rows_per_batch(spark: SparkSession, n: int):
    """Arrow batches of ``n`` rows while wide rows pass to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and its vector of integers floor(1024 * x)."""
    x = F.col("embedding")
    number = lambda v: v.cast("double")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(number(v)) & (F.abs(number(v)) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(finite)
    fits = lambda v: F.abs(number(v)) < LIMIT / SCALE
    whole = lambda v: F.when(fits(v), F.floor(number(v) * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a component of 2**52 or more has no exact scores")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("vec"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit_pivots(rows: list[np.ndarray], top: float, n: int, rounds: int = 4) -> np.ndarray:
    """Pivots in the lifted space by k-means from evenly spaced starts."""
    x = lifted(np.array(rows, np.float64), top)
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1, keepdims=True)))])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All distances; by differences where cancellation would spoil them."""
    out = np.empty((len(x), len(c)))
    for j, p in enumerate(c):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, in the fastest arithmetic that holds them."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def slack(dim: int) -> float:
    """A bound of the rounding of a squared length in ``dim`` dimensions, relative and generous."""
    return (dim + 8) * 2.0**-50


def build_index(vectors: DataFrame, *, k: int, pivots: int = 16, annuli: int = 16, sample: int = 4096) -> tuple[DataFrame, DataFrame, dict]:
    """Keyed vectors, their blocks and the bounded directory of the index."""
    spark = vectors.sparkSession
    base = stage(quantised(vectors).dropDuplicates(["vec_id", "vec"]), "topk-rows")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    largest = F.max(F.array_max(F.transform("vec", lambda v: F.abs(v)))).alias("most")
    found = base.groupBy(F.size("vec").alias("dim")).agg(F.max(norm).alias("top"), largest).collect()
    tops = {r.dim: r.top for r in found}
    kind = "int" if max((r.most for r in found), default=0) < 2**31 else "bigint"  # what moves is as narrow as it can be
    base = base.withColumn("vec", F.col("vec").cast(f"array<{kind}>"))
    chosen: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).collect():
        chosen.setdefault(len(r.vec), []).append(r.vec)
    centres = {d: fit_pivots(v, tops[d], pivots) for d, v in chosen.items()}

    def assign(batches):
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            dims = np.array(vecs.value_lengths())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                part = vecs.take(pa.array(at))
                x = lifted(matrix(part, d).astype(np.float64), tops[d])
                far = distances(x, centres[d]) if d in centres else np.zeros((len(at), 1))
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), part, pa.array(np.full(len(at), d, np.int32)), pa.array((near if d in centres else near - 1).astype(np.int32)), pa.array(far[np.arange(len(at)), near])], ["vec_id", "vec", "dim", "pivot", "r"])

    keyed = stage(base.mapInArrow(assign, f"vec_id long, vec array<{kind}>, dim int, pivot int, r double"), "topk-keys")
    cuts = keyed.groupBy("dim", "pivot").agg(F.percentile_approx("r", [i / annuli for i in range(1, annuli)], 2000).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: c < F.col("r"))).alias("ring")
    keyed = stage(keyed.join(F.broadcast(cuts), ["dim", "pivot"]).select("vec_id", "vec", *CELL[:2], ring, "r"), "topk-rings")  # cuts: one row a pivot

    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    kept = keyed.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
    kept = stage(kept, "topk-kept")
    cells = kept.groupBy(*CELL).agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n"))
    lines = {(r.dim, r.pivot, r.ring): (r.low, r.high, r.n) for r in cells.collect()}
    sizes = spark.createDataFrame([(*c, -(-v[2] // BLOCK)) for c, v in lines.items()], "dim int, pivot int, ring int, parts long")
    blocks = kept.join(F.broadcast(sizes), CELL).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))  # sizes: one row a ring
    blocks = blocks.groupBy(*CELL, "part").agg(F.collect_list(F.struct("r", "vec_id", "vec")).alias("rows"))
    return keyed, stage(blocks, "topk-blocks"), {"tops": tops, "centres": centres, "lines": lines, "kind": kind}


def unpack(value: pa.StructScalar | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ids and vectors of a packed block, sorted by r."""
    rows = value.values
    r = rows.field("r").to_numpy(zero_copy_only=False)
    order = np.argsort(r, kind="stable")
    return r[order], rows.field("vec_id").to_numpy(zero_copy_only=False)[order], matrix(rows.field("vec"), dim)[order]


def kth(scores: np.ndarray, k: int) -> int | None:
    """The k-th highest score, at most what a long holds; None if there are fewer or it lies below all longs: no bound."""
    if len(scores) < k:
        return None
    found = sorted(scores.tolist())[-k] if scores.dtype == object else int(np.partition(scores, len(scores) - k)[len(scores) - k])
    return min(found, 2**63 - 1) if found >= -(2**63) else None


def in_long(score: int) -> int:
    """A score as a long; one below all longs becomes the least, which ``search`` refuses as an answer."""
    if score >= 2**63:
        raise ValueError(f"the score {score} of an answer does not fit a long")
    return max(score, -(2**63))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: high score first, then small id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


PACKED = "dim int, pivot int, ring int, pack long, queries array<struct<r:double,vec_id:bigint,vec:array<KIND>>>"


def search(vectors: DataFrame, is_query, *, k: int = 10, **options) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best among all other rows."""
    spark = vectors.sparkSession
    keyed, blocks, index = build_index(vectors, k=k, **options)
    tops, centres, lines = index["tops"], index["centres"], index["lines"]
    packed = PACKED.replace("KIND", index["kind"])
    counts = {(r.dim, r.pivot, r.ring): r.n for r in keyed.where(is_query).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = spark.createDataFrame([(*c, -(-n // PACK)) for c, n in counts.items()], "dim int, pivot int, ring int, packs long")
    packs = keyed.where(is_query).join(F.broadcast(sizes), CELL).withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.col("packs")))  # sizes: one row a ring
    packs = packs.groupBy(*CELL, "pack").agg(F.collect_list(F.struct("r", "vec_id", "vec")).alias("queries"))

    def first_look(batches):
        """The k-th product in one block of the home ring: a bound for each query."""
        for b in batches:
            bounds = []
            for i in range(b.num_rows):
                d = b.column(0)[i].as_py()
                q_ids, q = b.column(4)[i].values.field("vec_id").to_numpy(zero_copy_only=False), matrix(b.column(4)[i].values.field("vec"), d)
                _, ids, x = unpack(b.column(5)[i], d)
                s = products(q, x)
                row = []
                for j, own in enumerate(q_ids):
                    others = s[j][ids != own]
                    row.append(kth(others, k))
                bounds.append(row)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(bounds, pa.list_(pa.int64()))], ["dim", "pivot", "ring", "pack", "queries", "bounds"])

    # Blocks are dealt by a hash of ids, so part 0 of a ring is there whenever any is; its least part is read.
    home = blocks.join(blocks.groupBy(*CELL).agg(F.min("part").alias("part")), [*CELL, "part"]).drop("part")
    with rows_per_batch(spark, 8):
        looked = stage(packs.join(home, CELL).select(*CELL, "pack", "queries", "rows").mapInArrow(first_look, packed + ", bounds array<bigint>"), "topk-looked")

    def expand(batches):
        """Each pack to the rings that its queries' radii reach, nearest ring first."""
        for b in batches:
            for i in range(b.num_rows):
                d = b.column(0)[i].as_py()
                q, bounds = matrix(b.column(4)[i].values.field("vec"), d).astype(np.float64), b.column(5)[i].as_py()
                norms = (q * q).sum(1)
                radius = np.array([np.inf if t is None else np.sqrt(max(0.0, n + tops[d] - 2.0 * t) + slack(d) * (n + tops[d])) for t, n in zip(bounds, norms)])
                radius = radius + slack(d) * (np.sqrt(norms) + 2 * np.sqrt(tops[d]))
                far = distances(np.hstack([q, np.zeros((len(q), 1))]), centres[d]) if d in centres else np.zeros((len(q), 1))
                found = []
                for (dim, pivot, ring), (low, high, _) in lines.items():
                    if dim != d:
                        continue
                    gap = np.zeros(len(q)) if pivot < 0 else np.maximum(0.0, np.maximum(low - far[:, pivot], far[:, pivot] - high))
                    if (gap <= radius).any():
                        at = np.maximum(0, pivot)
                        found.append((gap.min(), pivot, ring, (gap <= radius).tolist(), (far[:, at] - radius).tolist(), (far[:, at] + radius).tolist()))
                found.sort(key=lambda x: x[:3])
                n = len(found)
                home_cell = [x.as_py() for x in (b.column(1)[i], b.column(2)[i], b.column(3)[i])]
                same = pa.array(np.full(n, i), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * n, pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array(["/".join(map(str, home_cell))] * n), b.column(4).take(same), b.column(5).take(same)]
                    + [pa.array([x[c] for x in found], pa.list_(t)) for c, t in ((3, pa.bool_()), (4, pa.float64()), (5, pa.float64()))],
                    ["dim", "pivot", "ring", "pack", "queries", "bounds", "meets", "low", "high"],
                )

    reach = looked.mapInArrow(expand, packed.replace("pack long", "pack string") + ", bounds array<bigint>, meets array<boolean>, low array<double>, high array<double>")

    def score(batches):
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                d = b.column(0)[i].as_py()
                queries = b.column(1)[i].values
                q_ids, q = queries.field("vec_id").to_numpy(zero_copy_only=False), matrix(queries.field("vec"), d)
                bounds, low, high = b.column(2)[i].as_py(), np.array(b.column(4)[i].as_py()), np.array(b.column(5)[i].as_py())
                meets = np.flatnonzero(b.column(3)[i].as_py())
                r, ids, x = unpack(b.column(6)[i], d)
                pivotless = b.column(7)[i].as_py() < 0
                # the part of the sorted ring that any of these queries' intervals reaches
                a, z = (0, len(r)) if pivotless else (np.searchsorted(r, low[meets].min(), "left"), np.searchsorted(r, high[meets].max(), "right"))
                if a >= z:
                    continue
                s = products(q[meets], x[a:z])
                for j, row in zip(meets, s):
                    reaches = ids[a:z] != q_ids[j]
                    at = np.flatnonzero(reaches if bounds[j] is None else reaches & (row >= bounds[j]))
                    top = at[best(ids[a:z][at], row[at], k)]
                    out += [(int(q_ids[j]), int(v), in_long(int(w)), int(w) < -(2**63)) for v, w in zip(ids[a:z][top], row[top])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["query_id", "vec_id", "score", "below"])

    with rows_per_batch(spark, 8):
        met = reach.join(blocks, CELL).select("dim", "queries", "bounds", "meets", "low", "high", "rows", "pivot")
        partial = stage(met.mapInArrow(score, "query_id long, vec_id long, score long, below boolean"), "topk-partial")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answers = partial.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    score = F.when(F.col("below"), F.raise_error(F.lit("the score of an answer does not fit a long")).cast("long")).otherwise(F.col("score"))
    return answers.select("query_id", "rank", "vec_id", score.alias("score"))


def op5_pivot_topk(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
