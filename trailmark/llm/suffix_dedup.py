"""Exact substring dedup across documents by sparse prefix doubling.

Every byte covered by a ``least``-byte string that also starts in a document
with a smaller id is removed. Prefix doubling ranks positions by their first h
bytes, then by the pair of ranks at i and i + h, doubling h until a position is
unique or the threshold is reached. Ranks only have to tell strings apart, so a
rank is the 64-bit fingerprint of its bytes, and since a document's own ranks
pair up locally only ranks that other documents may share are moved and sorted.

* h = least / 2. Of the positions of a string of ``least`` bytes one is enough
  to find it: the least-ranked position of each window (its anchor), which two
  equal windows share. Anchors, a fourteenth of all positions, are shuffled in
  packed form, bucket by bucket of their ranks, and sorted. An anchor whose rank
  occurs in one document is unique: its windows are done.
* A run of windows with one anchor is a block. Where a smaller document has the
  same block, all its windows are repeated and no position moves again.
* Other blocks of a shared rank double: for each window the pair of ranks at i
  and i + h is sent, once per distinct block, sorted and reranked; windows whose
  pair occurs in a smaller document are repeated.

Equal texts are found first. Of the largest groups of them (a bounded table)
only the text with the smallest id takes part.

Hot strings. The smallest document of a block is a minimum, so tasks take it
over what they read and answer the other documents themselves: of a block that
very many documents share, one entry a task and buffer travels. An anchor that
very many documents have in different blocks (hot anchors, a bounded table from
a hashed share of all documents) is dealt by block, not by rank; its blocks
double without being asked. Which anchors are hot only moves work.
There are as many buckets as the bytes of the table ask for.

Defined results: a null or empty text has no bytes; a null id takes no part as
a smaller id and loses nothing; rows that share an id are compared with smaller
ids only; an empty table gives an empty result; extra columns are kept by
``remove_repeats`` and not read otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.hashing import U, mix, powers, prefix_sums, salt, text_bytes
from trailmark.llm.ngram_join import by_bucket, dealt
from trailmark.llm.shared import lean, release, stage, table, texts_of
from trailmark.llm.telephony import slices

LEAST = 50
TEXT_BYTES, EMIT_BYTES, BUCKET_BYTES = 700_000, 4 << 20, 16 << 20
GROUPS, HOT_ANCHORS = 1 << 15, 1 << 18
SAMPLED, HOT = 64, 64  # one document in SAMPLED is looked at; an anchor of HOT of those is hot
PAIR_ROWS = 1 << 20
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("fp", "<u8")])
EMPTY = hashlib.sha256(b"").hexdigest()


def window_ranks(sums: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of data[i:i + size] for every i."""
    n = len(sums) - 1
    if n < size:
        return np.zeros(0, U)
    _, back = powers(n)
    return mix((sums[size:] - sums[: n - size + 1]) * back[: n - size + 1])


def blocks_of(data: np.ndarray, at: np.ndarray, least: int):
    """Anchor blocks of the texts of a buffer, and the ranks of half windows.

    Returns first and last window start, document number, key (the anchor's
    rank) and content code of each block, and the half ranks of all positions.
    """
    half = least // 2
    sums = prefix_sums(data)
    ranks = window_ranks(sums, half)
    span = least - half + 1  # half windows in a window
    n = len(data) - least + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, U), np.zeros(0, U), ranks
    value, place, width = ranks, np.arange(len(ranks), dtype=np.int32 if len(ranks) < 2**31 else np.int64), 1
    while width < span:  # leftmost least rank of growing windows
        step = min(width, span - width)
        m = len(value) - step
        later = value[step:] < value[:m]
        value, place = np.where(later, value[step:], value[:m]), np.where(later, place[step:], place[:m])
        width += step
    doc = np.repeat(np.arange(len(at) - 1), np.maximum(0, np.diff(at) - least + 1))
    start = np.concatenate([np.arange(a, z - least + 1) for a, z in zip(at[:-1], at[1:]) if z - a >= least] or [none])
    if not len(start):
        return none, none, none, np.zeros(0, U), np.zeros(0, U), ranks
    anchor = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, z, p = start[first], start[last], anchor[first].astype(np.int64)
    _, back = powers(len(data))
    content = (sums[z + least] - sums[a]) * back[a]
    code = mix(content + (z - a).astype(U) * salt(3) + (p - a).astype(U) * salt(5))
    return a, z, doc[first], ranks[p], code, ranks


def block_code(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(fp + salt(7)))


def block_codes(rows: np.ndarray) -> np.ndarray:
    return block_code(rows["key"], rows["fp"])


def pair_ranks(ranks: np.ndarray, start: np.ndarray, least: int) -> np.ndarray:
    """The doubled rank of windows: of the pair of ranks at i and i + h."""
    return mix(ranks[start] + mix(ranks[start + (least - least // 2)] ^ salt(9)))


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All starts of blocks and the block each belongs to."""
    n = last - first + 1
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner], owner


def block_entries(b: pa.RecordBatch, least: int) -> np.ndarray:
    """Distinct (anchor rank, document, block) entries of a batch of (doc_id, text)."""
    data, at = text_bytes(b.column(1))
    _, _, doc, key, code, _ = blocks_of(data, at, least)
    rows = np.empty(len(key), ENTRY)
    rows["key"], rows["doc"], rows["fp"] = key, b.column(0).to_numpy()[doc] if len(doc) else 0, code
    # a text that repeats itself has few distinct blocks
    code = block_codes(rows)
    order = np.lexsort((code, doc))
    rows, code, doc = rows[order], code[order], doc[order]
    new = np.ones(len(rows), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return rows[new]


def hot_anchors(texts: DataFrame, least: int, sampled: int, hot: int) -> np.ndarray:
    """Ranks, sorted, of anchors that ``hot`` blocks of one document in ``sampled`` have: at most HOT_ANCHORS."""

    def run(batches):
        for b in slices(batches, 1, TEXT_BYTES):
            key, n = np.unique(block_entries(b, least)["key"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    drawn = texts.where(F.pmod(F.xxhash64(F.lit("anchor"), "doc_id"), F.lit(sampled)) == 0).select("doc_id", "text")
    counts = drawn.mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= hot)
    return np.sort(np.array([r.key for r in counts.orderBy(F.desc("n"), "key").limit(HOT_ANCHORS).collect()], np.int64).view(U))


def answers(doc: np.ndarray, code: np.ndarray, kind: np.ndarray | int, buckets: int, through: bool = False) -> pa.RecordBatch:
    """Entries (code, document, kind) by bucket of documents; negative where they only pass through the next step."""
    out = np.empty(len(doc), ENTRY)
    out["key"], out["doc"], out["fp"] = code, doc, kind
    bucket = (mix(doc.astype(U)) % U(buckets)).astype(np.int64)
    return pack_entries(out, -1 - bucket if through else bucket)


def send(rows: np.ndarray, codes, hot: np.ndarray, buckets: int):
    """Packed entries of the smallest document of each block, and answers to its other documents."""
    if not len(rows):
        return
    code = codes(rows)
    order = np.argsort(code)
    rows, code = rows[order], code[order]
    new = np.ones(len(rows), bool)
    new[1:] = code[1:] != code[:-1]
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(rows["doc"], starts)
    first = rows[starts]
    first["doc"] = least
    to = np.where(member(first["key"], hot.tobytes()), code[starts], first["key"])
    yield pack_entries(first, (mix(to) % U(buckets)).astype(np.int64))
    later = np.flatnonzero(rows["doc"] > least[np.cumsum(new) - 1])
    if len(later):
        yield answers(rows["doc"][later], code[later], REPEATED, buckets, through=True)


def passed(bucket: int, blob: np.ndarray) -> pa.RecordBatch:
    """Answers on their way to the documents' bucket."""
    return pa.RecordBatch.from_arrays([pa.array([-1 - bucket], pa.int32()), pa.array([blob.tobytes()], pa.binary())], ["bucket", "rows"])


def anchors(texts: DataFrame, buckets: int, least: int, hot: np.ndarray) -> DataFrame:
    """bucket, rows: distinct (anchor rank, document, block) entries, and answers."""

    def run(batches):
        held, size = [], 0
        for b in slices(batches, 1, TEXT_BYTES):
            held.append(block_entries(b, least))
            size += b.column(1).nbytes
            if size >= EMIT_BYTES:
                yield from send(np.concatenate(held), block_codes, hot, buckets)
                held, size = [], 0
        if held:
            yield from send(np.concatenate(held), block_codes, hot, buckets)

    return dealt(texts.select("doc_id", "text").mapInArrow(lean(run), "bucket int, rows binary"), buckets)


def pack_entries(rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Entries by bucket, column by column; documents as numbers in a short list."""
    order = np.lexsort((rows["doc"], bucket))
    rows, bucket = rows[order], bucket[order]
    start = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)) if len(bucket) else np.zeros(0, np.int64)
    out = []
    for a, z in zip(start, np.append(start[1:], len(rows))):
        part = rows[a:z]
        docs, number = np.unique(part["doc"], return_inverse=True)
        out.append(np.array([len(docs), len(part)], "<u4").tobytes() + docs.tobytes() + number.astype("<u4").tobytes() + part["key"].tobytes() + part["fp"].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "rows"])


def unpack_entries(blobs: np.ndarray) -> np.ndarray:
    """Entries of all the packed parts of a bucket."""
    data, at, out = blobs.tobytes(), 0, []
    while at < len(data):
        m, n = np.frombuffer(data, "<u4", 2, at)
        m, n = int(m), int(n)
        rows = np.empty(n, ENTRY)
        docs = np.frombuffer(data, "<i8", m, at + 8)
        at += 8 + 8 * m
        rows["doc"] = docs[np.frombuffer(data, "<u4", n, at)]
        rows["key"] = np.frombuffer(data, "<u8", n, at + 4 * n)
        rows["fp"] = np.frombuffer(data, "<u8", n, at + 12 * n)
        at += 20 * n
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, ENTRY)


REPEATED, DOUBLE = 1, 2


def compare_blocks(entries: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """bucket (of documents), rows: what each document learns of its blocks."""

    def run(batches):
        for bucket, blobs in by_bucket(batches, np.uint8):
            if bucket < 0:
                yield passed(bucket, blobs)
                continue
            rows = unpack_entries(blobs)
            rows = rows[np.lexsort((rows["doc"], rows["fp"], rows["key"]))]
            key, fp, doc = rows["key"], rows["fp"], rows["doc"]
            new_key, new = np.ones(len(rows), bool), np.ones(len(rows), bool)
            new_key[1:] = key[1:] != key[:-1]
            new[1:] = new_key[1:] | (fp[1:] != fp[:-1])
            block, owner = np.flatnonzero(new), np.cumsum(new) - 1
            least = doc[block]  # the smallest document of each (key, block)
            of_key = np.cumsum(new_key[block]) - 1
            starts = np.flatnonzero(new_key[block])
            least_of_key = np.minimum.reduceat(least, starts) if len(starts) else least
            several = np.bincount(of_key, minlength=len(starts))[of_key] > 1 if len(starts) else np.zeros(0, bool)
            varied = several & (np.maximum.reduceat(least, starts)[of_key] > least_of_key[of_key]) if len(starts) else several
            varied = varied | member(key[block], hot.tobytes())  # other blocks of these are elsewhere
            repeated = doc > least[owner]
            double = ~repeated & varied[owner] & (doc == least[owner])
            pick = np.flatnonzero(repeated | double)
            if not len(pick):
                continue
            yield answers(doc[pick], block_codes(rows[pick]), np.where(repeated[pick], REPEATED, DOUBLE), buckets)

    return dealt(entries.mapInArrow(lean(run), "bucket int, rows binary"), buckets)


def per_document(told: DataFrame) -> DataFrame:
    """doc_id, repeated, double: sorted codes of each document."""

    def run(batches):
        for _, blobs in by_bucket(batches, np.uint8):
            rows = unpack_entries(blobs)
            rows = rows[np.lexsort((rows["key"], rows["doc"]))]
            cut = np.flatnonzero(np.diff(rows["doc"])) + 1
            for a in range(0, len(cut) + 1, 1000):
                bounds = np.concatenate([[0], cut, [len(rows)]])[a : a + 1001]
                parts = [rows[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                codes = [[np.unique(p["key"][p["fp"] == kind]).tobytes() for p in parts] for kind in (REPEATED, DOUBLE)]
                yield pa.RecordBatch.from_arrays([pa.array([int(p["doc"][0]) for p in parts], pa.int64()), *(pa.array(c, pa.binary()) for c in codes)], ["doc_id", "repeated", "double"])

    return told.mapInArrow(lean(run), "doc_id long, repeated binary, double binary")


def member(values: np.ndarray, codes: bytes | None) -> np.ndarray:
    table_ = np.frombuffer(codes or b"", U)
    if not len(table_):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table_, values), len(table_) - 1)
    return table_[at] == values


def double_ranks(docs: DataFrame, found: DataFrame, buckets: int, least: int) -> DataFrame:
    """doc_id, pairs: the doubled ranks of a document that a smaller one has."""

    none = np.zeros(0, U)

    def emit(batches):
        held, size = [], 0
        for b in slices(batches, 1, TEXT_BYTES):
            data, at = text_bytes(b.column(1))
            first, last, doc, key, code, ranks = blocks_of(data, at, least)
            codes = block_code(key, code)
            pick = np.zeros(len(codes), bool)
            for i in range(b.num_rows):
                mine = slice(*np.searchsorted(doc, [i, i + 1]))
                pick[mine] = member(codes[mine], b.column(2)[i].as_py())
            start, owner = spread(first[pick], last[pick])
            rows = np.empty(len(start), ENTRY)
            rows["key"], rows["doc"], rows["fp"] = pair_ranks(ranks, start, least), b.column(0).to_numpy()[doc[pick][owner]] if len(start) else 0, 0
            held.append(np.unique(rows))
            size += len(held[-1])
            if size >= PAIR_ROWS:
                yield from send(np.concatenate(held), lambda rows: rows["key"], none, buckets)
                held, size = [], 0
        if held:
            yield from send(np.concatenate(held), lambda rows: rows["key"], none, buckets)

    def rerank(batches):
        for bucket, blobs in by_bucket(batches, np.uint8):
            if bucket < 0:
                yield passed(bucket, blobs)
                continue
            rows = np.unique(unpack_entries(blobs))  # by key, then document
            new = np.ones(len(rows), bool)
            new[1:] = rows["key"][1:] != rows["key"][:-1]
            least_doc = rows["doc"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(rows) else rows["doc"]
            later = rows[rows["doc"] > least_doc]
            yield answers(later["doc"], later["key"], REPEATED, buckets)

    wanted = found.where(F.octet_length("double") > 0).select("doc_id", "double")
    sent = texts_of(docs.select("doc_id", "text"), wanted).select("doc_id", "text", "double").mapInArrow(lean(emit), "bucket int, rows binary")
    sent = dealt(sent, buckets).mapInArrow(lean(rerank), "bucket int, rows binary")
    return per_document(dealt(sent, buckets)).select("doc_id", F.col("repeated").alias("pairs"))


def removed_spans(data: np.ndarray, at: np.ndarray, repeated: list, pairs: list, least: int) -> list[np.ndarray]:
    """For each text of a buffer its maximal removed runs, as rows of [start, end)."""
    first, last, doc, key, code, ranks = blocks_of(data, at, least)
    codes = block_code(key, code)
    out = []
    for i in range(len(at) - 1):
        mine = slice(*np.searchsorted(doc, [i, i + 1]))
        a, z, whole = first[mine], last[mine], member(codes[mine], repeated[i])
        start, _ = spread(a[~whole], z[~whole])
        if pairs[i]:
            start = start[member(pair_ranks(ranks, start, least), pairs[i])]
        else:
            start = start[:0]
        low, high = np.concatenate([a[whole], start]), np.concatenate([z[whole], start]) + least
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order]) if len(high) else high
        if len(low):
            new = np.ones(len(low), bool)
            new[1:] = low[1:] > high[:-1]
            ends = np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)
            out.append(np.stack([low[new], high[ends]], 1) - at[i])
        else:
            out.append(np.zeros((0, 2), np.int64))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_repeats(docs: DataFrame, *, least: int = LEAST, sampled: int = SAMPLED, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, text_sha, n_bytes, copy), and the removed spans of touched texts.

    ``copy`` marks a text of ``least`` bytes or more that a smaller id has whole.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sha = F.unhex(F.sha2(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")), 256))
    known = stage(docs.select("doc_id", sha.alias("text_sha"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "dedup-texts")
    first = known.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= least)).groupBy("text_sha").agg(F.min("doc_id").alias("least_id"), F.min("n_bytes").alias("n"), F.count(F.lit(1)).alias("copies"))
    first = stage(first, "dedup-first")
    total = first.agg(F.sum("n")).collect()[0][0] or 0
    # a thirteenth of all positions, 24 bytes each
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 24 / 13 / BUCKET_BYTES) + 1)

    # Copies in the largest groups of equal texts stay out; those in others only cost their own entries.
    groups = first.where("copies > 1").orderBy(F.desc("copies"), "text_sha").limit(GROUPS).select("text_sha", "least_id")
    leaders = docs.where(F.octet_length("text") >= least).withColumn("text_sha", sha).join(F.broadcast(groups), "text_sha", "left")  # groups: at most GROUPS rows
    leaders = leaders.where(F.col("least_id").isNull() | (F.col("doc_id") == F.col("least_id"))).where("doc_id is not null").select("doc_id", "text")
    split = hot_anchors(leaders, least, sampled, hot)
    found = stage(per_document(compare_blocks(anchors(leaders, buckets, least, split), buckets, split)), "dedup-blocks")
    release(spark)
    pairs = stage(double_ranks(docs, found, buckets, least), "dedup-pairs")
    release(spark)

    def cut(batches):
        for b in slices(batches, 1, TEXT_BYTES):
            data, at = text_bytes(b.column(1))
            spans = removed_spans(data, at, b.column(2).to_pylist(), b.column(3).to_pylist(), least)
            kept, text_sha = [], []
            for i, s in enumerate(spans):
                mine = data[at[i] : at[i + 1]]
                keep = np.ones(len(mine), bool)
                for x, y in s:
                    keep[x:y] = False
                kept.append(hashlib.sha256(mine[keep].tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(mine.tobytes()).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_sha, pa.binary()), pa.array([[{"start": x, "end": y} for x, y in s.tolist()] for s in spans], SPANS), pa.array(kept, pa.string())], ["doc_id", "text_sha", "spans", "kept_sha256"])

    touched = found.where(F.octet_length("repeated") > 0).select("doc_id", "repeated").join(pairs, "doc_id", "full")
    cuts = texts_of(docs.select("doc_id", "text"), stage(touched, "dedup-touched")).select("doc_id", "text", "repeated", "pairs")
    cuts = stage(cuts.mapInArrow(lean(cut), "doc_id long, text_sha binary, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string").dropDuplicates(["doc_id", "text_sha"]), "dedup-cuts")
    # hot texts: the side that is joined has one row a text, and Spark splits the other
    rows = known.join(first.select("text_sha", "least_id"), "text_sha", "left")
    rows = rows.select("doc_id", "text_sha", "n_bytes", F.coalesce(F.col("doc_id") > F.col("least_id"), F.lit(False)).alias("copy"))
    return rows, cuts.where(F.size("spans") > 0)


def repeated_substrings(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows, cuts = find_repeats(docs, **options)
    out = rows.join(cuts, ["doc_id", "text_sha"], "left")
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    whole = F.col("copy")
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce(size, F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.when(F.col("spans").isNull(), F.lit(0)).otherwise(F.size("spans"))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("text_sha")))).alias("kept_sha256"),
    )


def kept_text(data: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left of UTF-8 bytes; characters that a span only touches stay."""
    out, at = [], 0
    for start, end in spans:
        while start < len(data) and data[start] & 0xC0 == 0x80:
            start += 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end > start:
            out.append(data[at:start])
            at = end
    return b"".join([*out, data[at:]]).decode()


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from ``text`` and ``n_chars`` set anew; no column name is reserved."""
    rows, cuts = find_repeats(docs.select("doc_id", "text"), **options)
    whole = rows.where("copy").select("doc_id", "text_sha", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans")).distinct()
    some = cuts.select("doc_id", "text_sha", F.lit(False).alias("copy"), "spans")
    found = whole.unionByName(some.join(whole, ["doc_id", "text_sha"], "left_anti"))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        flat = (pa.RecordBatch.from_arrays([*b.column(0).flatten(), b.column(1), b.column(2)], [*names, "", ""]) for b in batches)
        for b in slices(flat, at):
            n, texts = len(names), []
            for text, copy, spans in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                texts.append("" if copy else text if not spans else kept_text(text.encode(), [(s["start"], s["end"]) for s in spans]))
            columns = [b.column(i) for i in range(n)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    sha = F.unhex(F.sha2(F.coalesce(F.encode("d.row.text", "UTF-8"), F.lit(b"")), 256))
    met = docs.select(F.struct("*").alias("row")).alias("d").join(found.alias("f"), (F.col("d.row.doc_id") == F.col("f.doc_id")) & (sha == F.col("f.text_sha")), "left")
    out = met.select("d.row", "f.copy", "f.spans").mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op4_suffix_array_dedup(spark, sf_dir):
    return repeated_substrings(table(spark, sf_dir, "documents"))
