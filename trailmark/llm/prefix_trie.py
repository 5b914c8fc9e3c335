"""The trie of conversation prefixes, summed by heavy-path decomposition.

Conversations are rebuilt from their donor's first turns and their own. A node is a
distinct sequence of first turns, found as the running fingerprint (two 64-bit sums)
of a conversation's turns; (smallest member, depth) names it.

* A node's *heavy* child is the one with most members (ties: the smaller conv_id).
  Nodes that follow each other by heavy edges are a path. The nodes that one
  conversation names are a vertical run, cut where its next node is not heavy; runs
  that continue each other are linked by pointer doubling.
* A path's own sums are an aggregate. A light child has at most half of its parent's
  members, so at most log2(conversations) light edges lie above a node: in as many
  rounds every path whose light paths are summed is added to the path that it hangs on.
* Then the sums of light subtrees are known where they hang, and one suffix sum along
  the path arrays gives each node's subtree.

Runs, prefixes and paths are scanned by ``scan``, which splits a key of any size.
Conversation ids of a node travel packed, at most ``CHUNK`` bytes a row, and are
hashed as a stream; SHA-256 of one node's list is sequential by definition.

Defined results: rows without a conv_id take no part; equal turns of a conversation
are ordered by the SHA-256 of role and text; rows that repeat are turns of their own;
an empty table gives an empty result, without a root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.scan import scan, staged
from trailmark.llm.shared import drop_stage, lean, stage, table

CHUNK = 1 << 18
FAMILY, HEADS = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest, words of the original turns, and depth (from 1) in their order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).where("conv_id is not null")
    return scan(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")])


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, key_*, before_*, words: the turns of rebuilt conversations."""
    head = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(HEADS))
    takers = convs.select(F.col("conv_id").alias("taker"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("conv_id"), head("conv_id").alias("h"))
    given = turns.where(F.col("depth") < HEADS).join(takers, "conv_id").where(F.col("depth") <= F.col("h"))
    given = given.select(F.col("taker").alias("conv_id"), F.lit(0).alias("own"), "depth", "digest", "words")
    own = turns.where(F.col("depth") > head("conv_id")).select("conv_id", F.lit(1).alias("own"), "depth", "digest", "words")
    both = given.unionAll(own).select("conv_id", "own", F.col("depth").alias("at"), *(F.xxhash64(F.lit(i), "digest").alias(n) for i, n in ((1, "a"), (2, "b"))), "words")
    return scan(both, ["conv_id"], [F.col("own"), F.col("at")], hashes=["a", "b"])


def digests(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: of each node's (depth, a, b) conv_ids in ascending order."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            key = [np.asarray(b.column(i)) for i in range(3)]
            ids = b.column(3).to_pylist()
            new = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))) if len(ids) else np.zeros(0, int)
            rows = []
            for start, end in zip(new.tolist(), [*new[1:].tolist(), len(ids)]):
                for at in range(start, end, CHUNK // 20):
                    part = ids[at : min(end, at + CHUNK // 20)]
                    rows.append((int(key[0][start]), int(key[1][start]), int(key[2][start]), part[0], ",".join(map(str, part)).encode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["depth", "a", "b", "first", "ids"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            done = []
            for depth, x, y, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4)):
                if (depth, x, y) == last:
                    state.update(b",")
                else:
                    if last:
                        done.append((*last, state.hexdigest()))
                    last, state = (depth, x, y), hashlib.sha256()
                state.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * 4, found)], names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*last, state.hexdigest()), found)], names)

    kinds = [pa.int64()] * 4 + [pa.binary()]
    found, names = [pa.int64()] * 3 + [pa.string()], ["depth", "a", "b", "ends_sha256"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["depth", "a", "b", "conv_id"]
    packed = stage(ends.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(lean(pack), "depth long, a long, b long, first long, ids binary"), "trie-ends")
    whole = packed.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first").mapInArrow(lean(digest), "depth long, a long, b long, ends_sha256 string")
    out = stage(whole, "trie-digests")
    drop_stage(packed)
    return out


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent, n_convs, n_children, heavy, words, a, b: every node, the root included."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("conv_id is not null")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    found = rows.groupBy("depth", F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    found = found.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("before_a").alias("pa"), F.min("before_b").alias("pb"))
    plain = stage(root.unionByName(found), "trie-nodes")
    first = plain.where("depth = 0").first()
    # the root's children need no join; other parents have their key's columns in one row
    up = plain.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent"))
    near = plain.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(first.conv_id if first else None).cast("long")))
    linked = stage(near.unionByName(plain.where("depth > 1").join(up, ["depth", "pa", "pb"])).drop("pa", "pb"), "trie-linked")
    drop_stage(plain)
    below = linked.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    below = stage(below.agg(F.count("*").alias("n_children"), F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("largest")), "trie-children")
    heavy = below.select(F.col("largest").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    out = linked.join(below.drop("largest"), ["conv_id", "depth"], "left").join(heavy, ["conv_id", "depth"], "left")
    out = stage(out.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "heavy": F.coalesce("heavy", F.lit(False))}), "trie-heavy")
    drop_stage(linked, below)
    return out


def with_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with path_conv and path_depth, the head of the heavy path that each is on."""
    starts = ~F.col("heavy") | (F.col("parent") != F.col("conv_id"))
    runs = scan(nodes.withColumnRenamed("depth", "level").withColumn("start", F.when(starts, F.col("level")).otherwise(F.lit(-1).cast("long"))), ["conv_id"], [F.col("level")], tops=["start"])
    runs = staged(runs.drop("depth", "start").withColumnsRenamed({"level": "depth", "top_start": "run"}), "trie-runs")
    node = runs.select(F.col("conv_id").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("run").alias("up_run"))
    # a run that begins with another run's heavy child continues that run
    links = runs.where("heavy and depth = run").select("conv_id", "run", "parent", "depth").join(node, ["parent", "depth"])
    links = stage(links.select("conv_id", "run", F.col("parent").alias("head_conv"), F.col("up_run").alias("head_run")), "trie-links")
    while True:
        nxt = links.select(F.col("conv_id").alias("head_conv"), F.col("run").alias("head_run"), F.col("head_conv").alias("far_conv"), F.col("head_run").alias("far_run"))
        jumped = links.join(nxt, ["head_conv", "head_run"], "left")
        jumped = stage(jumped.select("conv_id", "run", F.coalesce("far_conv", "head_conv").alias("head_conv"), F.coalesce("far_run", "head_run").alias("head_run"), F.col("far_conv").isNotNull().alias("moved")), "trie-links")
        drop_stage(links)
        links = jumped
        if not links.where("moved").limit(1).count():
            break
    out = runs.join(links.drop("moved"), ["conv_id", "run"], "left")
    out = stage(out.withColumns({"path_conv": F.coalesce("head_conv", "conv_id"), "path_depth": F.coalesce("head_run", "run")}).drop("run", "head_conv", "head_run"), "trie-paths")
    drop_stage(runs, links)
    return out


PATH = ["path_conv", "path_depth"]


def light_sums(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, leaves, saved: sums of the light subtrees that hang on each node."""
    own = nodes.groupBy(*PATH).agg(F.sum("leaf").alias("leaves"), F.sum("cost").alias("saved"))
    heads = nodes.where("conv_id = path_conv and depth = path_depth and depth > 0").select(*PATH, "parent", (F.col("depth") - 1).alias("at"))
    over = nodes.select(F.col("conv_id").alias("parent"), F.col("depth").alias("at"), F.col("path_conv").alias("up_conv"), F.col("path_depth").alias("up_depth"))
    hung = heads.join(over, ["parent", "at"])
    waiting = hung.groupBy(F.col("up_conv").alias("path_conv"), F.col("up_depth").alias("path_depth")).agg(F.count("*").alias("open"))
    paths = stage(own.join(hung, PATH, "left").join(waiting, PATH, "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long"))), "trie-open")
    done = []
    while True:
        summed = stage(paths.where("open = 0 and parent is not null"), "trie-summed")
        done.append(summed)
        gain = summed.groupBy(F.col("up_conv").alias("path_conv"), F.col("up_depth").alias("path_depth")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("much"), F.count("*").alias("n"))
        zero = F.lit(0).cast("long")
        rest = paths.where("open > 0").join(gain, PATH, "left")
        rest = stage(rest.select(*PATH, (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("saved") + F.coalesce("much", zero)).alias("saved"), "parent", "at", "up_conv", "up_depth", (F.col("open") - F.coalesce("n", zero)).alias("open")), "trie-open")
        drop_stage(paths)
        paths = rest
        if not paths.limit(1).count():
            break
    light = done[0]
    for d in done[1:]:
        light = light.unionAll(d)
    out = stage(light.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-light")
    drop_stage(paths, *done)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = staged(turns_of(conversations).drop("turn"), "trie-turns")
    convs = stage(turns.select("conv_id").distinct(), "trie-convs")
    rows = staged(rebuilt(turns, convs).drop("own", "at", "a", "b"), "trie-rows")
    drop_stage(turns)
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "key_a", "key_b"), "depth").alias("end"))
    zero = F.lit(0).cast("long")
    ends = digests(convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"end.{k}"), zero).alias(n) for k, n in (("depth", "depth"), ("key_a", "a"), ("key_b", "b")))))
    nodes = nodes_of(rows, convs)
    drop_stage(rows, convs)
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "cost": (F.col("n_convs") - 1) * F.col("words")})
    nodes = with_paths(nodes)
    light = light_sums(nodes)
    full = nodes.join(light, ["conv_id", "depth"], "left").join(ends, ["depth", "a", "b"], "left")
    full = full.withColumns({"leaf": F.col("leaf") + F.coalesce("leaves", zero), "cost": F.col("cost") + F.coalesce("saved", zero)}).withColumnRenamed("depth", "level")
    out = scan(full.select(*PATH, "conv_id", "level", "parent", "n_convs", "n_children", "leaf", "cost", "ends_sha256"), PATH, [F.col("level").desc()], sums=["leaf", "cost"])
    drop_stage(nodes, light, ends)
    return out.select(
        "conv_id", F.col("level").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("sum_leaf").alias("n_leaves"), F.col("sum_cost").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op12_heavy_path_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = "list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, d: list_reduce(list_concat([xor(c, d)], [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
ORACLE = f"""
WITH filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM filled),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM filled)),
parts AS (SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.donor AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
rebuilt AS (SELECT conv_id, CAST(row_number() OVER w AS BIGINT) AS depth, sha256(CAST(list({{'r': role, 't': text}}) OVER w AS VARCHAR)) AS key,
  CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
members AS (SELECT conv_id, depth, key, words FROM rebuilt UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS full_depth FROM members),
nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
  sha256(coalesce(string_agg(CASE WHEN depth = full_depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM sized GROUP BY depth, key),
lines AS (SELECT n.depth, n.key, n.conv_id, n.n_convs, n.words, n.ends_sha256, m.depth AS up_depth, m.key AS up_key FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth),
children AS (SELECT up_depth AS depth, up_key AS key, count(*) AS n_children FROM lines WHERE up_depth = depth - 1 GROUP BY up_depth, up_key),
known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, key)),
sums AS (SELECT l.up_depth AS depth, l.up_key AS key, CAST(sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((k.n_convs - 1) * k.words) AS BIGINT) AS saved_tokens
  FROM lines l JOIN known k ON k.depth = l.depth AND k.key = l.key GROUP BY l.up_depth, l.up_key)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM known k JOIN sums s USING (depth, key) LEFT JOIN (SELECT l.depth, l.key, n.conv_id FROM lines l JOIN nodes n ON n.depth = l.up_depth AND n.key = l.up_key WHERE l.up_depth = l.depth - 1) p USING (depth, key)
"""
