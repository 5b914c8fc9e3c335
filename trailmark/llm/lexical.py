"""Ranked lexical search over a two-level quantised index.

``build_index`` cuts the documents into blocks of about 4 MB of text and writes one
row a block: an inverted index of its own documents, so that no posting is ever
shuffled and a frequent term is as long in a block as the block has documents.

* Level 1, cheap: a byte a posting, the term's impact in the document in steps of
  ``STEP``, rounded upwards. Weighted sums of bytes bound a score from above, and
  the same sums less one step a matched term bound it from below.
* Level 2, exact: how often the term occurs, and how long the document is.

``search`` takes items in blocks of at most ``ITEMS`` rows. A task goes through its
index blocks with the k highest lower bounds of each item at hand; every document
whose upper bound reaches the k-th of them is scored again in whole numbers from
level 2. A task's k best exact scores an item are merged by a window.

Terms are maximal runs of ASCII letters and digits and of all code points beyond
ASCII; only A-Z are lower-cased. They travel as 64-bit fingerprints: two different
terms share one with chance 2**-64, and nothing else is approximate.

Defined results: null and empty texts have no term, are not counted and never
found; as items they have no rows. Rows that repeat a doc_id are documents of their
own, as are items; a null doc_id comes after all others of its score. Equal scores
go to the smaller doc_id. An empty table on either side gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailmark.llm import hashing
from trailmark.llm.bpe import places
from trailmark.llm.shared import drop_stage, lean, stage, table
from trailmark.llm.telephony import slices

K, ITEMS, BLOCK_BYTES, BLOCK_ROWS = 20, 1024, 4 << 20, 1 << 16
STEP = 3922  # 255 steps reach over every impact, which is below 10**6
# The score's constants.
UNIT, K1, B_ALL, B_PART = 1_000_000_000, 12, 100, 25
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
INDEX = "doc_ids array<long>, sizes binary, terms binary, ends binary, docs binary, impacts binary, counts binary"


def term_edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms begin and end in texts that lie one after the other."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = TERM[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a term ends where its text does
    begins[edge] |= inside[edge + 1]
    ends[edge - 1] |= inside[edge]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all terms of all texts, and where each text's begin (and the end)."""
    data, at = hashing.text_bytes(column)
    start, end = term_edges(data, at)
    prints = hashing.spans(hashing.prefix_sums(hashing.LOWER[data]), start, end) if len(start) else np.zeros(0, np.uint64)
    return prints, np.searchsorted(start, at)


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and the terms of all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n = terms = 0
        for b in slices(batches, 0, BLOCK_BYTES):
            data, at = hashing.text_bytes(b.column(0))
            sizes = np.diff(np.searchsorted(term_edges(data, at)[0], at))
            n, terms = n + int((sizes > 0).sum()), terms + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([terms], pa.int64())], ["n", "terms"])

    row = docs.select("text").mapInArrow(lean(run), "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def length_part(sizes: np.ndarray, n: int, terms: int) -> np.ndarray:
    return B_ALL - B_PART + B_PART * sizes.astype(np.int64) * n // terms


def impact(count: np.ndarray, part: np.ndarray) -> np.ndarray:
    count = count.astype(np.int64)
    return UNIT * count // (1000 * count + K1 * part)


def block_row(doc_ids: pa.Array, texts: pa.Array, n: int, terms: int) -> list | None:
    """One block's index, as the values of a row of ``INDEX``."""
    prints, at = terms_of(texts)
    sizes = np.diff(at)
    has = np.flatnonzero(sizes)
    if not len(has):
        return None
    owner = np.repeat(np.arange(len(has)), sizes[has])
    order = np.argsort(prints, kind="stable")  # by term, then by document
    prints, owner = prints[order], owner[order]
    first = np.ones(len(prints), bool)
    first[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(prints)))
    prints, owner = prints[at], owner[at]
    last = np.append(prints[1:] != prints[:-1], True)
    steps = -(-impact(counts, length_part(sizes[has], n, terms)[owner]) // STEP)
    return [
        doc_ids.take(pa.array(has)).to_pylist(), sizes[has].astype("<u4").tobytes(), prints[last].astype("<u8").tobytes(), (np.flatnonzero(last) + 1).astype("<u4").tobytes(),
        owner.astype("<u2").tobytes(), steps.astype("u1").tobytes(), counts.astype("<u4").tobytes(),
    ]


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The staged index, the number of documents with a term, and of all their terms."""
    n, terms = totals(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for big in slices(batches, 1, BLOCK_BYTES):
            for start in range(0, big.num_rows, BLOCK_ROWS):
                b = big.slice(start, BLOCK_ROWS)
                row = block_row(b.column(0), b.column(1), n, terms)
                if row:
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in row[1:]]], names)

    names = [part.split()[0] for part in INDEX.split(", ")]
    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), INDEX)
    return stage(index, "lexical-index", "zstd"), n, terms


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents each of the wanted terms (sorted fingerprints) is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found = np.zeros(len(wanted), np.int64)
        for b in batches:
            for terms, ends in zip(b.column(0), b.column(1)):
                terms, ends = np.frombuffer(terms.as_buffer(), "<u8"), np.frombuffer(ends.as_buffer(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                found += np.where(terms[at] == wanted, np.diff(ends, prepend=0)[at], 0)
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(found[hit], pa.int64())], ["term", "df"])

    rows = index.select("terms", "ends").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.collect()}  # at most one row a wanted term


class Best:
    """The k best documents of one item as far as a task has come."""

    def __init__(self, k: int):
        self.k, self.lower, self.rows = k, np.zeros(0, np.int64), []

    def threshold(self) -> int:
        """The k-th highest lower bound, or 1: only scores above 0 count."""
        low = int(self.lower[0]) if len(self.lower) == self.k else 1
        return max(low, -self.rows[-1][0] if len(self.rows) == self.k else 1, 1)

    def bound(self, lower: np.ndarray) -> None:
        both = np.concatenate([self.lower, lower[lower > 0]])
        self.lower = np.sort(np.partition(both, len(both) - self.k)[-self.k :] if len(both) > self.k else both)

    def add(self, scores: Iterable[int], ids: Iterable[int | None]) -> None:
        self.rows += [(-s, i is None, i or 0) for s, i in zip(scores, ids) if s > 0]
        self.rows = sorted(self.rows)[: self.k]


def score_block(block: dict, wanted: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], best: list[Best], n: int, terms: int) -> int:
    """Enter one block's documents; how many were scored exactly."""
    known = np.frombuffer(block["terms"], "<u8")
    ends = np.frombuffer(block["ends"], "<u4").astype(np.int64)
    docs, impacts, counts = np.frombuffer(block["docs"], "<u2"), np.frombuffer(block["impacts"], "u1"), np.frombuffer(block["counts"], "<u4")
    part = length_part(np.frombuffer(block["sizes"], "<u4"), n, terms)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    there = known[at] == wanted
    begin = np.where(at > 0, ends[at - 1], 0)
    size = np.where(there, ends[at] - begin, 0)
    rescored = 0
    for (which, weight), own in zip(items, best):
        held = size[which] > 0
        which, weight = which[held], weight[held]
        if not len(which):
            continue
        place = places(begin[which], size[which])
        doc, each = docs[place], np.repeat(weight, size[which])
        # sums of whole numbers below 2**53 are exact in doubles
        upper = np.bincount(doc, each * impacts[place], len(part))
        lower = upper - np.bincount(doc, each, len(part))
        own.bound((lower * STEP).astype(np.int64))
        reaches = upper * STEP >= own.threshold()
        chosen = np.flatnonzero(reaches)
        if not len(chosen):
            continue
        rescored += len(chosen)
        mine = reaches[doc]
        place, doc = place[mine], doc[mine]
        exact = np.zeros(len(part), np.int64)
        np.add.at(exact, doc, each[mine] * impact(counts[place], part[doc]))
        own.add(exact[chosen].tolist(), [block["doc_ids"][i] for i in chosen.tolist()])
    return rescored


def search_block(index: DataFrame, item_terms: list[np.ndarray], n: int, terms: int, k: int) -> DataFrame:
    """item (place in the list), doc_id, score: the k best of every task's documents."""
    wanted = np.unique(np.concatenate(item_terms))
    df = document_frequencies(index, wanted)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(wanted))], np.int64)
    items = []
    for prints in item_terms:
        distinct, repeats = np.unique(prints, return_counts=True)
        which = np.searchsorted(wanted, distinct)
        items.append((which, weight[which] * repeats))
    shared = index.sparkSession.sparkContext.broadcast((wanted, items))  # at most ITEMS texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        wanted, items = shared.value
        best = [Best(k) for _ in items]
        for b in batches:
            for i in range(b.num_rows):
                score_block({name: b.column(name)[i].as_py() for name in b.schema.names}, wanted, items, best, n, terms)
        rows = [(item, None if null else i, -s) for item, own in enumerate(best) for s, null, i in own.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], ["item", "doc_id", "score"])

    found = index.mapInArrow(lean(run), "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def item_blocks(items: DataFrame) -> Iterable[list]:
    """item_id and text of staged items, at most ITEMS rows at a time."""
    numbered = stage(items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("row")), "lexical-items")
    block = F.floor(F.col("row") / ITEMS)
    for b in sorted(r.block for r in numbered.select(block.alias("block")).distinct().collect()):
        yield numbered.where((F.col("row") >= b * ITEMS) & (F.col("row") < (b + 1) * ITEMS)).collect()
    drop_stage(numbered)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, *, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents."""
    index, n, terms = build_index(docs)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for rows in item_blocks(items):
        prints, at = terms_of(pa.array([r.text for r in rows], pa.large_string()))
        asked = [(r.item_id, prints[a:z]) for r, a, z in zip(rows, at[:-1], at[1:]) if z > a]
        if not n or not asked:
            continue
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(asked)], "item long, item_id long")
        part = search_block(index, [p for _, p in asked], n, terms, k).join(F.broadcast(names), "item")
        found = found.unionAll(stage(part.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical-found"))
    drop_stage(index)
    return found


def op13_quantised_search(spark, sf_dir):
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS terms FROM documents), sized AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sized),
asked AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""
