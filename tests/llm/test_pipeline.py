import zlib
from collections import defaultdict

import corpus_pipeline as P
from tests.compare import same_rows
from trailmark.llm.registry import ORACLES, QUERIES

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(QUERIES[name](spark, DATA), ORACLES[name])


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, [r.asDict() for r in docs.collect()]
    for i, (name, function) in enumerate(P.STAGES):
        out = function(spark, docs, DATA)
        if i < 4:
            assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0 and len(rows) > 0


def test_each_stage_is_its_operator(spark):
    from trailmark.llm import ngram_join, suffix_dedup

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = P.STAGES[1][1](spark, docs, DATA)
    leaders = {r.component_id for r in ngram_join.ngram_jaccard(docs).collect()}
    assert {r.doc_id for r in one.collect()} == leaders
    cut = {r.doc_id: len(r.text.encode()) for r in P.STAGES[2][1](spark, docs, DATA).collect()}
    for r in suffix_dedup.repeated_substrings(docs).collect():
        # characters that a removed run only touches stay whole
        assert 0 <= cut[r.doc_id] - (r.n_bytes - r.n_removed) <= 6 * max(1, r.n_spans)


def test_packed_rows_are_whole_documents(spark):
    from trailmark.llm.packing import END, ids_of

    import numpy as np
    import public_tokenizers

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    pieces = defaultdict(list)
    for r in P.STAGES[4][1](spark, docs, DATA).collect():
        pieces[r.doc_id].append(r)
    rows = docs.collect()
    for r, data in zip(rows, ids_of(public_tokenizers.path("word_bpe_49k.json"))([r.text or "" for r in rows])):
        ids = np.append(np.frombuffer(data, "<u4"), np.uint32(END)).astype("<u4")
        for p in pieces[r.doc_id]:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        assert sum(p.length for p in pieces[r.doc_id]) == len(ids)


ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "no id at all", None, "a", 11), (3, "tie " * 30, "en", "a", 120), (4, "tie " * 30, "en", "a", 120), (4, "tie " * 30, "en", "b", 120), (5, "long " * 30000, "de", "b", 150000), (6, "one two", "en", "b", 7)]


def test_each_stage_takes_odd_rows_clashing_names_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, class long, copies int, spans string"
    docs = spark.createDataFrame([(*r, 1, 2, "clash") for r in ODD], schema)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (6, 0, 0)], "doc_id long, quality long, toxic long")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for i, (name, function) in enumerate(P.STAGES):
        out = function(spark, docs, str(tmp_path))
        got = out.collect()
        assert i == 4 or out.columns == docs.columns, name
        ids = sorted((r.doc_id for r in got if r.doc_id is not None))
        if name == "n-gram Jaccard join":
            assert ids == [1, 2, 3, 5, 6] and len(got) == 6
        if name == "suffix-array dedup":
            assert ids == [1, 2, 3, 4, 4, 5, 6] and all(r.text == "" for r in got if r.doc_id == 4)
        if name == "packing":
            assert {r.doc_id for r in got} == {r[0] for r in ODD}
        assert function(spark, docs.where("false"), str(tmp_path)).collect() == [], name


def test_run_applies_all_stages(spark):
    out = P.run(spark, DATA)
    assert out.columns == P.STAGES[4][1](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).columns and out.count() > 0
