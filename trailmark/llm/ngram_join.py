"""N-gram Jaccard self-join by T-occurrence search, with link components.

A document is the set of its k-word shingles. Two sets of similarity t or more
share T >= ceil(t * n) shingles, n the larger size. DivideSkip splits a set's
inverted lists into L long ones and the rest, finds candidates that occur
T - L times or more on the short lists by merging these, and completes their
counts by binary probes of the long lists. Here L = T - 1: a set's shingles are
ordered from rare to frequent, the lists of the first n - T + 1 are short, and
one common entry makes a candidate.

* Equal sets are one class, found by fingerprint; every later step sees a class
  once a task, however many copies it has.
* Frequencies: a fixed share of all occurrences, drawn by hash over all
  documents, is counted; the ``frequent`` most common shingles (a bounded table)
  go last, by count, the others keep the order of their hashes. The order only
  moves work; any order finds the same pairs.
* Merging: postings of the short lists are shuffled in packed form and sorted,
  list by list. Lists with equal members count once. Frequent lists are sorted
  in parts by several tasks and are one list again afterwards.
* A list only pairs members that may reach the overlap with what follows its
  shingle in both (the list of their first common shingle always does).
* Candidates are compared first with the leader of their list, the member that
  has fewest words of its own. Components of the links so found make most other
  pairs needless: lists in which several components meet are tried with a leader
  once more, then in full, so a group of near copies costs its size, not its
  square. In full, only members that come early in their own order look for
  partners; where unlike documents share a passage there are none.
* Probing: a candidate's remaining shingles are binary-searched in the other's
  sorted set.

Defined results: words and shingles as in ``hashing.shingles`` (fewer than k
words are one shingle); null, empty and blank texts have no shingles and no
links; rows without an id are grouped with equal texts only, and share the
component of a known id that has the same set (null where there is none);
repeated
rows are in one component; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.components import components
from trailmark.llm.hashing import U, mix, shingles
from trailmark.llm.shared import drop_stage, lean, release, stage, table, texts_of
from trailmark.llm.telephony import slices

K, PERCENT = 5, 80
SAMPLE_BITS, FREQUENT, LEAST_SAMPLED = 4, 1 << 18, 4
LIST_PART = 20_000
TEXT_BYTES = 700_000
SEEN = 200_000

PAIR = np.dtype([("c", "<u8"), ("n", "<u4"), ("p", "<u4")])
ROW = np.dtype([("x", "<u8"), ("c", "<u8"), ("n", "<u4"), ("p", "<u4")])


def set_code(s: np.ndarray) -> np.uint64:
    """A fingerprint of a set; 0 only for the empty one."""
    if not len(s):
        return U(0)
    code = mix(np.sum(mix(s ^ U(0x5851F42D4C957F2D)), keepdims=True, dtype=U) + U(len(s)))[0]
    return code if code else U(1)


def mark_of(s: np.ndarray) -> bytes:
    """Parities of the set's members over at least two cells a member.

    Two marks differ in no more cells than the sets differ in members.
    """
    cells = 1 << max(3, int(2 * len(s) - 1).bit_length()) if len(s) else 8
    return np.packbits(np.bincount((s & U(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """False only where the marks prove the sets too different."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) != len(y):  # the larger mark is folded onto the smaller
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    # similar sets share (n + m - d) / 2 of (n + m + d) / 2 members, d the number in one only
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def buckets_of(df: DataFrame, rows_each: int = 4000) -> int:
    """As many shuffle buckets as keep a bucket's postings in a few dozen MB."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_each))


def dealt(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed rows by bucket: some buckets a partition, so that partitions do not grow in number as fast as the data."""
    least = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(max(least, -(-buckets // 8)), "bucket").sortWithinPartitions("bucket")


def pack(values: np.ndarray, bucket: np.ndarray, name: str = "rows") -> pa.RecordBatch:
    """One binary row for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], cuts]) if len(bucket) else np.zeros(0, int)
    ends = np.concatenate([cuts, [len(bucket)]]) if len(bucket) else starts
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts.astype(int)].astype(np.int32)), pa.array([values[a:z].tobytes() for a, z in zip(starts, ends)], pa.binary())], ["bucket", name])


def by_bucket(batches, dtype):
    """Buckets of a partition that is sorted by bucket, one array each."""
    at, held = None, []
    for b in batches:
        for bucket, rows in zip(b.column(0).to_pylist(), b.column(1)):
            if bucket != at:
                if held:
                    yield at, np.concatenate(held)
                at, held = bucket, []
            held.append(np.frombuffer(rows.as_buffer(), dtype))
    if held:
        yield at, np.concatenate(held)


def classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, class, its mark, and a hashed share of its shingles for the frequency count."""

    def run(batches):
        seen: set = set()
        for b in slices(batches, 1, TEXT_BYTES):
            sets = shingles(b.column(1), k)
            codes = np.array([set_code(s) for s in sets], U)
            if len(seen) > SEEN:
                seen.clear()
            drawn = []
            for s, c in zip(sets, codes):
                fresh = len(s) and c not in seen
                seen.add(c)
                drawn.append(s[mix(s ^ c) & U((1 << SAMPLE_BITS) - 1) == 0].tobytes() if fresh else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(codes.view(np.int64)), pa.array([mark_of(s) for s in sets], pa.binary()), pa.array(drawn, pa.binary())], ["doc_id", "n_shingles", "class", "mark", "drawn"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, class long, mark binary, drawn binary")


def frequent_shingles(known: DataFrame, buckets: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, with their estimated counts: at most ``most``."""

    def deal(batches):
        for b in batches:
            x = np.concatenate([np.zeros(0, U), *(np.frombuffer(v.as_buffer(), U) for v in b.column(0) if v.is_valid)])
            yield pack(x, (x % U(buckets)).astype(np.int64))

    def count(batches):
        for _, x in by_bucket(batches, U):
            x, n = np.unique(x, return_counts=True)
            top = np.flatnonzero(n >= LEAST_SAMPLED)
            yield pa.RecordBatch.from_arrays([pa.array(x[top].view(np.int64)), pa.array(n[top])], ["x", "n"])

    sent = known.where("drawn is not null").select("drawn").mapInArrow(lean(deal), "bucket int, rows binary")
    rows = dealt(sent, buckets).mapInArrow(lean(count), "x long, n long").orderBy(F.desc("n"), "x").limit(most).collect()
    x = np.array([r.x for r in rows], np.int64).view(U)
    order = np.argsort(x)
    return x[order], np.array([r.n for r in rows], np.int64)[order] << SAMPLE_BITS


def short_lists(docs: DataFrame, buckets: int, frequent: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """Packed postings (shingle, class, size, place in the class's order) of every class's short lists."""
    xs, counts = frequent
    rank = np.empty(len(xs), np.int64)
    rank[np.lexsort((xs, counts))] = np.arange(len(xs))
    parts = (counts // LIST_PART + 1).astype(U)

    def run(batches):
        seen: set = set()
        for b in slices(batches, 0, TEXT_BYTES):
            if len(seen) > SEEN:
                seen.clear()
            held = []
            for s in shingles(b.column(0), k):
                c = set_code(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                short = len(s) - -(-percent * len(s) // 100) + 1
                if len(xs):
                    at = np.minimum(np.searchsorted(xs, s), len(xs) - 1)
                    common = xs[at] == s
                    rare = s[~common]
                    if len(rare) < short:
                        late = s[common][np.argsort(rank[at[common]])]
                        rare = np.concatenate([rare, late])
                    s, size = rare[:short], len(s)
                else:
                    s, size = s[:short], len(s)
                row = np.empty(len(s), ROW)
                row["x"], row["c"], row["n"], row["p"] = s, c, size, np.arange(len(s))
                held.append(row)
            if held:
                rows = np.concatenate(held)
                part = np.zeros(len(rows), U)
                if len(xs):
                    at = np.minimum(np.searchsorted(xs, rows["x"]), len(xs) - 1)
                    part = np.where(xs[at] == rows["x"], rows["c"] % parts[at], U(0))
                yield pack(rows, (mix(rows["x"] + part * U(0x9E3779B97F4A7C15)) % U(buckets)).astype(np.int64))

    return dealt(docs.select("text").mapInArrow(lean(run), "bucket int, rows binary"), buckets)


def merge_lists(postings: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """gid, part, members: lists of two or more classes, once for equal members.

    A part of a list that is dealt to several tasks carries the list's own gid.
    """
    xs, counts = frequent
    large = xs[counts >= LIST_PART]

    def run(batches):
        for bucket, rows in by_bucket(batches, ROW):
            rows = rows[np.lexsort((rows["c"], rows["x"]))]
            again = np.zeros(len(rows), bool)
            again[1:] = (rows["x"][1:] == rows["x"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
            rows = rows[~again]
            new = np.ones(len(rows), bool)
            new[1:] = rows["x"][1:] != rows["x"][:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(rows)))
            spread = np.isin(rows["x"][start], large)
            pick = (size > 1) | spread
            start, size, spread = start[pick], size[pick], spread[pick]
            if not len(start):
                continue
            member = np.repeat(np.arange(len(start)), size)
            at = np.concatenate([np.arange(a, a + n) for a, n in zip(start, size)])
            sums = np.zeros(len(start), U)
            np.add.at(sums, member, mix(rows["c"][at]))
            gid = np.where(spread, mix(rows["x"][start]), mix(sums + size.astype(U)))
            places = np.add.reduceat(rows["p"][at].astype(np.int64), np.cumsum(size) - size)
            # of lists with equal members the one that comes first in the order has the least places for all
            order = np.lexsort((places, np.where(spread, gid + np.arange(len(gid), dtype=U), gid)))
            _, first = np.unique(np.where(spread, gid + np.arange(len(gid), dtype=U), gid)[order], return_index=True)
            first = order[first]
            for a in range(0, len(first), 2000):
                some = first[a : a + 2000]
                members = [rows[["c", "n", "p"]][start[i] : start[i] + size[i]] for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(gid[some].view(np.int64)), pa.array(np.where(spread[some], bucket, 0).astype(np.int32)), pa.array(places[some]), pa.array([np.array(m, PAIR).tobytes() for m in members], pa.binary())], ["gid", "part", "places", "members"])

    lists = postings.mapInArrow(lean(run), "gid long, part int, places long, members binary")
    return lists.groupBy("gid", "part").agg(F.min_by("members", "places").alias("members"))


def exploded(lists: DataFrame) -> DataFrame:
    """gid, c, n, p: every member of every list."""

    def run(batches):
        for b in slices(batches, 1, 1 << 20):
            held = [np.frombuffer(x.as_buffer(), PAIR) for x in b.column(1)]
            rows = np.concatenate(held)
            columns = [np.repeat(b.column(0).to_numpy(), [len(m) for m in held]), rows["c"].astype(U).view(np.int64), rows["n"].astype(np.int64), rows["p"].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["gid", "c", "n", "p"])

    return lists.select("gid", "members").mapInArrow(lean(run), "gid long, c long, n long, p long")


def fits(percent: int):
    """Whether u and v may link if this list is of their first common shingle: what follows must suffice."""
    return F.expr(f"least(u.n - u.p, v.n - v.p) * {100 + percent} >= (u.n + v.n) * {percent}")


def verify(docs: DataFrame, pairs: DataFrame, one: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b): marks rule most others out, binary probes decide.

    one: class, doc_id, mark and n of every class.
    """

    def prune(batches):
        for b in batches:
            keep = [may_link(x, y, n, m, percent) for x, y, n, m in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def probe(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name, mark, n: one.select(F.col("class").alias(name), F.col("mark").alias(mark), F.col("n").alias(n))
    met = pairs.join(side("b", "y", "m"), "b").join(side("a", "x", "n"), "a").select("a", "b", "x", "y", "n", "m")
    close = stage(met.mapInArrow(lean(prune), "a long, b long"), "join-close")
    if close.isEmpty():
        return close
    wanted = close.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(one.select("class", "doc_id"), "class").where("doc_id is not null")
    sets = stage(class_sets(docs, stage(wanted, "join-wanted"), k), "join-sets")
    met = close.join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a")
    links = stage(met.select("a", "b", "x", "y").mapInArrow(lean(probe), "a long, b long").distinct(), "join-links")
    drop_stage(close, sets)
    return links


def class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """class -> set: the sorted shingles of one document of each wanted class."""

    def run(batches):
        for b in slices(batches, 1, TEXT_BYTES):
            sets = shingles(b.column(1), k)
            # of rows that share an id, those with other texts are not of this class
            own = [set_code(s).astype(np.int64) == c for s, c in zip(sets, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "set"]).filter(pa.array(own, pa.bool_()))

    # an id may be the least of several classes where rows share ids
    ids = wanted.groupBy("doc_id").agg(F.collect_set("class").alias("classes"))
    rows = texts_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)
    return rows.select(F.explode("classes").alias("class"), "text").mapInArrow(lean(run), "class long, set binary")


def with_labels(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """Members of the lists in which several components meet, with their component."""
    if label is None:
        return members.withColumn("label", F.col("c"))
    tagged = members.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    tagged = stage(tagged, "join-tagged")
    apart = tagged.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gid")
    # staged, as are leaders: Spark splits a hot list where both sides of a join come right from a shuffle
    return tagged.join(stage(apart, "join-apart"), "gid")


def leader_pairs(members: DataFrame, percent: int, second: bool = False) -> DataFrame:
    """Candidate pairs of each list's leader with its members of other components.

    The leader has the fewest words of its own before the list's shingle: what others were copied from.
    """
    order = F.struct((F.col("p") / F.col("n")).alias("own"), "c")
    leaders = lambda rows: stage(rows.groupBy("gid").agg(F.min_by(F.struct("c", "n", "p", "label"), order).alias("v")).select("gid", "v.*"), "join-leaders")
    first = leaders(members)
    if second:
        main = first.select("gid", F.col("label").alias("main"))
        members = members.join(main, "gid").where("label <> main").drop("main")
        first = leaders(members)
    met = members.alias("u").join(first.alias("v"), F.expr("u.gid = v.gid AND u.label <> v.label AND u.c <> v.c")).where(fits(percent))
    return met.select(F.least("u.c", "v.c").alias("a"), F.greatest("u.c", "v.c").alias("b")).distinct()


def second_pairs(members: DataFrame, percent: int) -> DataFrame:
    """The same for what is outside the component of a list's leader, with a leader of its own."""
    return leader_pairs(members, percent, second=True)


def all_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of all members of other components.

    Of two sets that may link, the smaller has at most (100 - percent) / (100 + percent)
    of its words before their first common shingle, so only such members look for
    partners: in the list of a passage that unlike documents share there are none.
    """
    early = members.where(f"p * {100 + percent} <= n * {100 - percent}")
    sized = "u.gid = v.gid AND u.label <> v.label AND u.c <> v.c AND u.n <= v.n"
    met = early.alias("u").join(members.alias("v"), F.expr(sized)).where(fits(percent))
    return met.select(F.least("u.c", "v.c").alias("a"), F.greatest("u.c", "v.c").alias("b")).distinct()


def ngram_jaccard(docs: DataFrame, *, k: int = K, percent: int = PERCENT, frequent: int = FREQUENT, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and class of every row.

    Components need only the links that connect them. With ``count_links`` every
    pair of a list is tried, at the cost of the square of a group's classes, and
    n_links is the number of other classes that a row's class is linked with.
    """
    spark = docs.sparkSession
    known = stage(classes(docs, k), "join-classes")
    buckets = buckets_of(known)
    common = frequent_shingles(known, buckets, frequent)
    lists = stage(merge_lists(short_lists(docs, buckets, common, k, percent), common), "join-lists")
    members = stage(exploded(lists), "join-members")
    release(spark)

    one = known.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_shingles").alias("n"))
    one = stage(one, "join-one")
    links = tried = label = None
    for pairs_of in (all_pairs,) if count_links else (leader_pairs, second_pairs, all_pairs):
        tagged = with_labels(members, label)
        pairs = pairs_of(tagged, percent)
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "join-pairs")
        if tried is not None and pairs.isEmpty():
            continue
        found = verify(docs, pairs, one, k, percent)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = components(links)
    drop_stage(lists, members)

    # one row a class: what its documents share
    of = one.select("class", F.col("doc_id").alias("least")).join(label.select(F.col("node").alias("class"), "label"), "class", "left")
    of = of.withColumn("label", F.coalesce("label", "class"))
    of = of.join(of.groupBy("label").agg(F.min("least").alias("component_id")), "label")
    counted = []
    if count_links:
        degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
        of, counted = of.join(degree, "class", "left"), [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    of = stage(of.select("class", "component_id", *counted), "join-labels")
    out = known.select("doc_id", "n_shingles", "class").join(of, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class", *counted)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of a component its smallest id, once.

    Of rows that repeat the id one stays. Rows without an id stay, as nothing can name them.
    """
    found = ngram_jaccard(docs, **options).where("doc_id = component_id").groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("again"))
    kept = docs.select(F.struct("*").alias("row")).join(found, F.col("row.doc_id") == F.col("doc_id")).select("row", "doc_id", "again")
    once = kept.where("not again").select("row.*")
    again = kept.where("again").dropDuplicates(["doc_id"]).select("row.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS x FROM w),
n AS (SELECT w.doc_id, count(s.x) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""
