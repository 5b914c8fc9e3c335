import random
import re

import pytest

from trailmark.llm import ngram_join as N


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows):
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # near copies of one text, from one to five edits away
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        rows.append((500 - i, " ".join(words)))
    chain = [word() for _ in range(60)]
    for i in range(12):  # each like the next, the ends unlike
        rows.append((600 + i, " ".join(chain)))
        chain[4 * i] = f"c{i}"
    passage = " ".join(word() for _ in range(30))
    rows += [(700 + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(40))) for i in range(60)]  # share a passage only
    rows += [(1000, "a b c"), (1001, "A b\t c"), (1002, ""), (1003, None), (1004, "a b c d"), (1000, "a b c"), (None, "a b c"), (None, "é É x y z q"), (1005, " \n "), (1006, "x " * 30000), (1007, "x " * 9)]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, class string, n int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_jaccard(docs).collect()), key=str)
    assert got == brute(rows)


def test_counted_links_equal_brute_force(spark):
    rows = corpus()[90:]
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    different = set(sets)
    want = [sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in different) if x else 0 for x in sets]
    assert max(want) > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = N.ngram_jaccard(docs, count_links=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == sorted(((d, n) for (d, _), n in zip(rows, want)), key=str)
    assert "n_links" not in N.ngram_jaccard(docs).columns


def test_without_a_frequency_table_the_result_is_the_same(spark):
    rows = corpus()[100:260]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_jaccard(docs, frequent=0).collect()), key=str)
    assert got == brute(rows)


def test_lists_dealt_to_several_tasks_are_one_list(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_PART", 20)
    monkeypatch.setattr(N, "LEAST_SAMPLED", 1)
    rows = corpus()[:162]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_jaccard(docs).collect()), key=str)
    assert got == brute(rows)


def test_marks_never_rule_out_similar_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) < 0.92]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert N.may_link(N.mark_of(a), N.mark_of(b), len(a), len(b), 80)


def test_keep_one(spark):
    rows = corpus()
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    names = {c for d, _, c in brute(rows) if d is not None}
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(names)


def test_empty_table(spark):
    assert N.ngram_jaccard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("k", [1, 3])
def test_other_shingle_lengths(spark, k):
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "z"), (4, "z")]
    got = {r.doc_id: r.n_shingles for r in N.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()}
    assert got == {i: len(shingle_set(t, k)) for i, t in rows}
