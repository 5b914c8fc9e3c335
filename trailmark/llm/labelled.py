"""Bounded samples of labelled documents, and the hold-out rule of their labels.

A model is fitted on at most ``bound`` labelled rows: those with the least
hashes of their ids, so that a sample does not depend on files or partitions.
Only their ids travel to every task, which pick the rows while they scan. Of rows
that repeat an id, the one with the smallest text is taken (a null text comes
last). The picked texts go to one task; they hold at most ``most_bytes``, and where
they would hold more, texts are taken in the order of the hashes while they fit.
Everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.llm.shared import stage

MOST_BYTES = 128 << 20


def held_out(modulus: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``rest``; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % modulus == rest


def sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, bound: int, per_class: bool, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, text, label of at most ``bound`` labelled ids outside the hold-out, one row an id and label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held).select("doc_id", F.col(label).cast("int").alias("label"))
    rank = F.xxhash64(F.lit("sample"), "doc_id")
    parts = [known.where(F.col("label") == c).distinct() for c in (0, 1)] if per_class else [known.distinct()]
    parts = [p.orderBy(rank, "doc_id", "label").limit(bound // len(parts)) for p in parts]
    ids = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ids = stage(ids, "label-ids")
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # ids: at most ``bound`` rows
    picked = stage(picked.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "label-rows")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    if (picked.agg(F.sum(size)).first()[0] or 0) > most_bytes:
        so_far = Window.orderBy(rank, "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0)
        fits = picked.select("doc_id", "label", size.alias("size")).where(F.col("size") <= most_bytes).withColumn("total", F.sum("size").over(so_far))  # at most ``bound`` numbers
        picked = picked.join(F.broadcast(fits.where(F.col("total") <= most_bytes).select("doc_id", "label")), ["doc_id", "label"])
    return picked.select("doc_id", "text", "label")


def fit(rows: DataFrame, train: Callable[[list[str], list[int]], bytes]) -> bytes:
    """Run ``train`` in one task over a bounded sample, in the order of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *batches])
        got = got.sort_values(["doc_id", "label", "text"], kind="stable")
        yield pd.DataFrame({"model": [train([x if isinstance(x, str) else "" for x in got.text], [int(x) for x in got.label])]})

    # a shuffle of at most ``bound`` rows, so that the scan before it keeps its tasks
    found = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return bytes(found[0].model) if found else train([], [])
