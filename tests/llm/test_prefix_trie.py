import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tests.compare import DATA, same_rows
from trailmark.llm import prefix_trie as T, scan as S

from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, depth string, parent int"


def plain(rows):
    """Nodes of the trie by enumerating every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = turns.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * words
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def random_turns(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.choice([0, 1, 2, 3, 4, 6])):
            rows.append((c * rng.choice([1, 1, 7]), t, rng.choice(["user", "assistant"]), rng.choice(words), "clash", 1))
    return rows


def odd_turns():
    rows = [(40, None, None, "null turn first"), (40, 1, "user", None), (40, 1, "user", "tie"), (40, 1, "user", "tie"), (40, 2, "", ""), (None, 1, "user", "no conversation")]
    rows += [(41, 0, "a", "b"), (61, 0, "ab", ""), (60, 5, "a", "b"), (60, 5, "", "ab"), (15, 3, "user", "x " * 30000)]
    rows += [(80, i, "user", "long") for i in range(900)] + [(c, i, "user", "copy of a copy") for c in range(100, 180) for i in range(5)]
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize("rows", [random_turns(1, 90, ["a b", "c", "", None]), random_turns(2, 60, ["x y z"]), odd_turns(), [(7, 1, "user", "alone", "", 0)]], ids=["branches", "runs", "odd", "one"])
def test_nodes_are_those_of_all_prefixes(spark, rows):
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert dict(got.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_empty_tables(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", 0)], SCHEMA)).collect() == []


def test_query_equals_sql(spark):
    same_rows(T.op12_heavy_path_trie(spark, DATA), T.ORACLE)


def test_paths_follow_the_largest_children(spark):
    rows = [(c, d, "user", f"turn {d if d < 3 or c % 3 else -c} {c % 5 if d > 5 else ''}") for c in range(200) for d in range(8)]
    turns = T.staged(T.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).drop("turn"), "t")
    convs = turns.select("conv_id").distinct()
    nodes = T.with_paths(T.nodes_of(T.staged(T.rebuilt(turns, convs), "r"), convs)).collect()
    named = {(n.conv_id, n.depth): n for n in nodes}
    for n in nodes:
        if n.depth:
            up = named[n.parent, n.depth - 1]
            same = (n.path_conv, n.path_depth) == (up.path_conv, up.path_depth)
            best = max((k for k in nodes if k.parent == n.parent and k.depth == n.depth), key=lambda k: (k.n_convs, -k.conv_id))
            assert same == (best is n) == n.heavy
            assert same or (n.path_conv, n.path_depth) == (n.conv_id, n.depth)


def test_scan_of_a_key_in_many_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, 5 + i]), i, rng.randint(-9, 9), rng.randint(0, 99), rng.getrandbits(62)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, o long, s long, t long, h long").repartition(5)
    got = {r.o: r for r in S.scan(df, ["k"], [F.col("o")], hashes=["h"], sums=["s"], tops=["t"]).collect()}
    state = {}
    for k, o, s, t, h in rows:
        depth, total, top, key = state.get(k, (0, 0, -1, 0))
        depth, total, top = depth + 1, total + s, max(top, t)
        before, key = key, (key + h * pow(int(S.BASE), depth, 1 << 64)) % (1 << 64)
        state[k] = depth, total, top, key
        r = got[o]
        assert (r.depth, r.sum_s, r.top_t, r.key_h % (1 << 64), r.before_h % (1 << 64)) == (depth, total, top, key, before)
    assert len(got) == len(rows)
