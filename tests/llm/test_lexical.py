import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import DATA, same_rows
from trailmark.llm import lexical as L

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score int, rank string"


def terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    """The score of every document for every item, in whole numbers."""
    docs = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, size = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in items:
        rows = []
        for doc_id, tf, length in docs:
            m, score = 75 + 25 * length * n // size, 0
            for t in terms(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(rows)[:k], 1)]
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "a", f"w{int(rng.paretovariate(0.7))}"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(600)]
    docs += [(1000 + i, "the same WORDS, the same") for i in range(70)] + [(5, "id again the"), (None, "no id the same"), (2000, None), (2001, ""), (2002, " -- "), (2003, "İx É ÀB a_b"), (2004, "same " * 20000)]
    items = [(1, "the same w1 w2 w3"), (2, "w4 w5 w5 w900 É"), (3, None), (4, "--"), (5, "nowhere"), (6, "WORDS the"), (None, "same"), (1, "w7"), (7, " ".join(f"w{i}" for i in range(1, 400)))]
    return docs, items


@pytest.mark.parametrize("block", [300, 1 << 22])
def test_rows_are_those_of_scoring_everything(spark, monkeypatch, block):
    docs, items = corpus()
    monkeypatch.setattr(L, "BLOCK_BYTES", block)
    monkeypatch.setattr(L, "ITEMS", 4)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).repartition(3)
    got = L.search(spark, d, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int").coalesce(1), k=20)
    assert [f.name for f in got.schema] == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(docs, items)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.withColumn("text", docs.text.substr(9, 1)), items)):
        assert L.search(spark, d, i).collect() == []


def test_steps_bound_impacts_and_spare_most_documents():
    docs, items = corpus()
    size = sum(len(terms(t)) for _, t in docs)
    names = [x.split()[0] for x in L.INDEX.split(", ")]
    block = dict(zip(names, L.block_row(pa.array([i for i, _ in docs]), pa.array([t for _, t in docs], pa.large_string()), len(docs), size)))
    part = L.length_part(np.frombuffer(block["sizes"], "<u4"), len(docs), size)
    exact = L.impact(np.frombuffer(block["counts"], "<u4"), part[np.frombuffer(block["docs"], "<u2")])
    steps = np.frombuffer(block["impacts"], "u1").astype(np.int64)
    assert (steps * L.STEP >= exact).all() and ((steps - 1) * L.STEP < exact).all()
    asked, _ = L.terms_of(pa.array(["w5 w6 w7"], pa.large_string()))
    best = [L.Best(5)]
    wanted = np.unique(asked)
    spared = L.score_block(block, wanted, [(np.arange(len(wanted)), np.full(len(wanted), 500))], best, len(docs), size)
    matching = sum(1 for _, t in docs if {"w5", "w6", "w7"} & set(terms(t)))
    assert 5 <= spared < matching / 2 and len(best[0].rows) == 5


def test_scores_come_from_documents_that_the_bytes_let_through(spark, monkeypatch):
    """Without level 1 nothing is found: no other path leads to a result."""
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    whole = L.block_row
    monkeypatch.setattr(L, "block_row", lambda *a: [b"\0" * len(x) if i == 5 else x for i, x in enumerate(whole(*a))])
    assert L.search(spark, docs, items).collect() == []


def test_query_equals_sql(spark):
    same_rows(L.op13_quantised_search(spark, DATA), L.ORACLE)
