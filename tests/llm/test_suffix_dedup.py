import hashlib
import random

import numpy as np
import pytest

from trailmark.llm import suffix_dedup as S
from trailmark.llm.hashing import U

SCHEMA = "doc_id long, text string, n_chars long, repeated string"


def brute(rows, least=50):
    first = {}
    for d, t in sorted(((d, t or "") for d, t in rows if d is not None)):
        b = t.encode()
        for i in range(len(b) - least + 1):
            first.setdefault(b[i : i + least], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if d is not None and first[b[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdéfgh ") for _ in range(6))
    shared = [" ".join(word() for _ in range(n)) for n in (8, 9, 12, 40, 90)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(3, 30))) for _ in range(3)]
        for p in rng.sample(shared, rng.randrange(3)):
            cut = rng.randrange(len(p) // 3)
            parts.insert(rng.randrange(4), p[cut : len(p) - rng.randrange(len(p) // 3)])
        rows.append((i * 3 % 61, " ".join(parts)))
    whole = " ".join(word() for _ in range(80))
    rows += [(200, whole), (201, whole), (199, whole), (202, whole[:300] + "X" + whole[300:])]
    rows += [(300, "ab" * 400), (301, "ab" * 30), (302, "a" * 49), (303, "a" * 50), (304, "a" * 51), (305, "a" * 49)]
    rows += [(310, ""), (311, None), (None, whole), (320, "x" * 20), (320, whole[:120]), (200, whole), (330, "long " * 30000), (331, "q" + "long " * 20000)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(d, t, len(t or ""), "clash") for d, t in rows], SCHEMA).repartition(parts)


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{"least": 50}, {"least": 21}, {"least": 50, "sampled": 1, "hot": 2}, {"least": 50, "sampled": 2, "hot": 1}])
def test_equals_brute_force(spark, options):
    rows = corpus()
    assert digest(S.repeated_substrings(frame(spark, rows), **options)) == brute(rows, options["least"])


def hot_corpus():
    """A line that all documents have, among other words in each; in a third of them with the same words."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    line = " ".join(word() for _ in range(9))
    same = " ".join(word() for _ in range(9)) + line + " ".join(word() for _ in range(9))
    return [(i * 7 % 601, word() + word() + (same if i % 3 else line) + word() + word() + " ".join(word() for _ in range(9))) for i in range(600)]


def test_hot_line_equals_brute_force(spark, monkeypatch):
    rows = hot_corpus()
    want = brute(rows)
    assert digest(S.repeated_substrings(frame(spark, rows), sampled=1, hot=20)) == want
    monkeypatch.setattr(S, "HOT_ANCHORS", 1)  # the table is full: the others are dealt by rank
    assert digest(S.repeated_substrings(frame(spark, rows), sampled=1, hot=20)) == want


def test_hot_anchors_are_spread(spark):
    """No bucket gets more than a part of a hot anchor, and a hot block is one entry a task."""
    rows, buckets = hot_corpus(), 16
    docs = frame(spark, rows, 4)
    hot = S.hot_anchors(docs, 50, 1, 20)
    assert 0 < len(hot) < 60
    met = {}
    for r in S.anchors(docs, buckets, 50, hot).where("bucket >= 0").collect():
        for e in S.unpack_entries(np.frombuffer(bytes(r.rows), np.uint8)):
            met.setdefault(int(e["key"]), {}).setdefault(r.bucket, []).append(int(e["fp"]))
    sizes = [[len(v) for v in met[int(k)].values()] for k in hot]
    assert max(map(sum, sizes)) >= 200 and all(max(n) <= max(8, sum(n) / 4) for n in sizes)
    for of_key in met.values():
        for fps in of_key.values():
            assert max(fps.count(x) for x in fps) <= 4


def test_blocks_that_agree_in_half_their_code_stay(spark):
    """Two texts round one anchor whose block codes have the same upper 32 bits."""
    n, size = 250_000, 75
    buffer = np.random.default_rng(1).integers(97, 123, (n, size), np.uint8)
    low = np.argmin(S.window_ranks(S.prefix_sums(buffer.ravel()[: 25 * n]), 25))
    buffer[:, 25:50] = buffer.ravel()[low : low + 25].copy()  # the anchor of all its windows
    first, last, doc, key, code, _ = S.blocks_of(buffer.ravel(), np.arange(n + 1) * size, 50)
    order = np.lexsort((code, key))
    key, code, doc = key[order], code[order], doc[order]
    near = np.flatnonzero((key[1:] == key[:-1]) & (code[1:] != code[:-1]) & (code[1:] >> U(32) == code[:-1] >> U(32)))
    assert len(near)
    rows = [(j, buffer[d].tobytes().decode()) for j, d in enumerate(x for i in near.tolist() for x in doc[i : i + 2].tolist())]
    got = S.repeated_substrings(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)


def test_texts_lose_their_repeats(spark):
    rows = [(1, "é" * 60 + "one"), (2, "two" + "é" * 60), (3, "é" * 60 + "one"), (4, "short"), (5, "short")]
    kept = {r.doc_id: r for r in S.remove_repeats(frame(spark, rows)).collect()}
    assert [kept[i].text for i in range(1, 6)] == ["é" * 60 + "one", "two", "", "short", "short"]
    assert kept[2].n_chars == 3 and kept[2].repeated == "clash"


def test_names_of_joined_columns_may_clash_and_empty_tables_pass(spark):
    rows = [(1, "a" * 60, True, "x", 7), (2, "b" + "a" * 60, False, "y", 8), (None, "a" * 60, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy boolean, spans string, dedup_id int")
    kept = S.remove_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a" * 60, True, "x", 7), (2, "b", False, "y", 8), (None, "a" * 60, None, None, None)], key=str)
    assert S.remove_repeats(docs.where("false")).collect() == []


def test_characters_stay_whole():
    data = "aé".encode() * 3
    assert S.kept_text(data, [(2, 5)]) == "aééaé"  # only the whole "a" at 3 goes
    assert S.kept_text(data, [(0, len(data))]) == "" and S.kept_text(data, []) == "aéaéaé"


def test_empty_table(spark):
    assert S.repeated_substrings(frame(spark, [])).collect() == []
