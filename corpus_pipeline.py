"""A corpus pipeline: quality, near duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.

In every stage: an empty table gives an empty one; columns beyond those of
``documents`` pass through under any name. Rows with a null or empty text are
scored like others; where they are good they have no shingles, no repeats and no
words, so the join and the dedup keep them and the mixture, which counts words,
drops them. Rows without an id are never near duplicates and lose no passage, and
are mixed and packed like others. Of rows that repeat an id the join keeps one.
Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import mixing, ngram_join, packing, quality, suffix_dedup
from trailmark.llm.shared import drop_stage, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.keep_one(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out."""
    return suffix_dedup.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until sources have their target weights."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids; one row a piece."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_array),
    ("mixing sources to target weights", mixture),
    ("packing", pack_sequences),
]
#: SQL cannot express the classifier, the byte-wise dedup or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        before, docs = docs, stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        drop_stage(before)  # what a stage has written is all that the next one reads
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
