"""Held-out accuracy on the small tables, and edge cases."""

import math
import zlib

import numpy as np
import pytest

from trailmark.llm import quality as Q, toxicity as X
from trailmark.llm.shared import table

DATA = "/root/testdata/sf0.01"
ODD = [(1, ""), (2, None), (3, " \n\t"), (4, "!!! ???"), (5, "word " * 20000), (None, "no id"), (6, "same"), (6, "same")]


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = np.array(label) == 1
    return (rank[pos].mean() - rank[~pos].mean()) / len(score) + 0.5


@pytest.mark.parametrize("fit,score,label,least", [(Q.fit_quality, Q.score_quality, "quality", 0.97), (X.fit_toxicity, X.score_toxicity, "toxic", 0.85)])
def test_held_out_documents(spark, fit, score, label, least):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = fit(docs, labels)
    rows = score(docs, model).join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert auc(np.array([r.score for r in rows]), [r[label] for r in rows]) > least
    odd = spark.createDataFrame([(*r, "en", 7.0) for r in ODD], "doc_id long, text string, lang string, score double")
    got = score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 6}) == 1
    assert score(odd.where("false"), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score_quality(docs, Q.fit_quality(docs, labels)).collect()} == {0.5}
    assert len({r.score for r in X.score_toxicity(docs, X.fit_toxicity(docs, labels)).collect()}) == 1


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    moves = rng.normal(0, 1, (2, 2))
    for n in (1, 2, 6):
        e = rng.normal(0, 1, n)
        total, on = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(v for v, t in zip(e, y) if t) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            on += w * np.array(y)
        assert np.allclose(X.marginals([e, np.zeros(0), e[:1]], moves)[0], on / total)


def test_expected_moves_sum_to_length():
    e = np.array([0.3, -1.0, 2.0, 0.1])
    assert np.isclose(X.expected(e, np.array([[0.2, -0.1], [0.4, 0.3]])).sum(), 3)


def test_spans_are_offsets_of_words():
    text = "ein, böses wort: hier"
    spans = X.spans_of(text, np.array([0.1, 0.9, 0.8, 0.2]), 0.5)
    assert [(text[s["start"] : s["end"]], s["probability"]) for s in spans] == [("böses wort", 0.9)]


def test_ftrl_learns_a_sparse_line():
    model = Q.Ftrl(4)
    for i in range(400):
        model.learn(np.array([i % 2, 3]), np.array([1.0, 1.0]), i % 2)
    w = model.weights(slice(None))
    assert w[1] > 0.5 > -0.5 > w[0] and w[2] == 0


def test_keep_good_passes_all_columns(spark):
    docs = table(spark, DATA, "documents")
    model = Q.fit_quality(docs, table(spark, DATA, "labels"))
    kept = Q.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.score_quality(docs, model).where("predicted = 1").collect()}


def plain_scores(spark, path, modulus, rest):
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    return [(d, t or "", zlib.crc32(str(d).encode()) % modulus == rest) for d, t in docs]


def test_quality_query_equals_a_plain_computation(spark):
    """held_out, score and predicted, recomputed feature by feature from the fitted weights."""
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    weights = np.frombuffer(Q.fit_quality(docs, labels), np.float32).astype(float)
    got = {r.doc_id: r for r in Q.op8_quality_ftrl(spark, path).collect()}
    mask = (1 << 64) - 1
    k1, k2, k3 = int(Q.K1), int(Q.K2), int(Q.K3)
    for d, text, held in plain_scores(spark, path, 4, 2):
        words = text.split()
        code = [Q.CODES[w] for w in words]
        core, shape = [c >> 16 for c in code], [c & 0xFFFF for c in code]
        kinds = [[c * k1 & mask for c in core], [s * k2 & mask for s in shape]]
        if len(words) > 1:
            kinds.append([k3 if a == b else (a * k1 + b * k3) & mask for a, b in zip(core, core[1:])])
            kinds.append([(a * k3 + b * k2 + 1) & mask for a, b in zip(shape, shape[1:])])
        total = weights[-1]
        for values in kinds:
            for x in values:
                total += weights[(((x ^ x >> 29) * k2 & mask) >> 31) & (1 << Q.BITS) - 1] * Q.GAIN / len(values)
        score = 1 / (1 + math.exp(-max(-35, min(35, total))))
        r = got[d]
        assert r.held_out == held and abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.7)
    assert len(got) == docs.count()


def test_toxicity_query_equals_a_plain_computation(spark):
    """held_out, score and predicted from the fitted field, marginals by unscaled forward-backward in logarithms."""
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = np.frombuffer(X.fit_toxicity(docs, labels), np.float32).astype(float)
    moves, head, emit = model[:4].reshape(2, 2), model[4:9], model[X.HEAD :]
    got = {r.doc_id: r for r in X.op9_toxicity_crf(spark, path).collect()}
    for d, text, held in plain_scores(spark, path, 5, 0):
        e = [sum(emit[t % X.SIZE] for t in X.traits(w)) for w in X.WORD.findall(text)]
        n = len(e)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(n):
            came = np.logaddexp(*(ahead[t - 1, a] + moves[a] for a in (0, 1))) if t else np.zeros(2)
            ahead[t] = came + [0.0, e[t]]
        for t in range(n - 2, -1, -1):
            back[t] = [np.logaddexp(moves[a, 0] + back[t + 1, 0], moves[a, 1] + e[t + 1] + back[t + 1, 1]) for a in (0, 1)]
        both = ahead + back
        p = 1 / (1 + np.exp(-np.clip(both[:, 1] - both[:, 0], -35, 35)))
        score = 1 / (1 + math.exp(-max(-35, min(35, head[0] + head[1:] @ X.summary(p)))))
        r = got[d]
        assert r.held_out == held and abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.5)
    assert len(got) == docs.count()


def test_samples_are_bounded_in_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from trailmark.llm import labelled

    docs = spark.range(50_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(100, 140).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")))
    labels = spark.createDataFrame([(3, 1), (3, 1), *((i, i % 2) for i in range(100, 140))], "doc_id long, quality int")
    rows = labelled.sample(docs, labels.where("doc_id = 3"), "quality", F.lit(False), 10, per_class=False).collect()
    assert [(r.doc_id, r.text, r.label) for r in rows] == [(3, "text 0", 1)]
    assert labelled.sample(docs, labels, "quality", F.lit(False), 20, per_class=True).count() == 20
    labels = labels.where("doc_id > 3")
    few = labelled.sample(docs, labels, "quality", F.lit(False), 20, per_class=True, most_bytes=5500).collect()
    assert len(few) == 5 and labelled.sample(docs, labels, "quality", F.lit(False), 20, per_class=True, most_bytes=10).collect() == []
