"""Packing token sequences: first-fit decreasing with a tournament tree of bins.

Documents are tokenised once, cut where a whole sequence is full, and their
pieces (never their tokens) are dealt into randomised groups of about
``group_size`` pieces. Each group is packed on its own: pieces by decreasing
length, each into the first open sequence that has room, which a tournament
tree over the free room of all sequences finds in logarithmic time. A group's
size does not depend on the input, so more data means more groups, not larger
tasks; whole sequences need no partner and pass through.

Tokenising uses the caller's vocabulary file. Its pre-tokens are independent of
each other, so the ids of those seen before come from a bounded table; texts
outside Latin-1, or with marks that the shortcut does not cover, go through the
tokenizer whole. Equal ids either way.

Defined results: a null or empty text is the end id alone; a null id is packed
like others; repeated rows are packed each; ties go by id, start and position;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.shared import lean, stage, table
from trailmark.llm.telephony import slices

LENGTH, GROUP, END = 2048, 8192, 1
# Fixed values of the tokenizer's pre-token pattern, restricted to lower-case Latin-1.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾a-zªµºß-öø-ÿ]+")
ODD = re.compile(r"[\x1c-\x1f]|<\|(?:start|end)oftext\|>")


# The pattern for which PRETOKEN stands; other tokenizers take no shortcut.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PieceIds(dict):
    """pre-token -> its ids as little-endian bytes."""

    MOST = 400_000

    def __init__(self, vocabulary: str):
        import json

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.single = Tokenizer.from_file(vocabulary), Tokenizer.from_file(vocabulary)
        steps = json.loads(self.whole.to_str())
        split = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.known_form = [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": PATTERN} and [x["type"] for x in split] == ["Split", "ByteLevel"]
        # pre-tokens are normalised and split already
        self.single.normalizer = normalizers.Sequence([])
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens.difference(self))
        if len(self) + len(new) > self.MOST:
            self.clear()
            new = list(tokens)
        for token, e in zip(new, self.single.encode_batch_fast(new, add_special_tokens=False)):
            ids = e.ids
            self[token] = struct.pack(f"<{len(ids)}I", *ids)

    def shortcut(self, text: str) -> list[str] | None:
        """The text's pre-tokens, if they are sure to be the tokenizer's own."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return PRETOKEN.findall(text.lower()) if self.known_form and not ODD.search(text) else None

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.shortcut(x) for x in texts]
        tokens: set[str] = set()
        for s in split:
            tokens.update(s or ())
        self.learn(tokens)
        whole = iter(self.whole.encode_batch_fast([x for x, s in zip(texts, split) if s is None], add_special_tokens=False))
        return [b"".join(map(self.__getitem__, s)) if s is not None else np.array(next(whole).ids, "<u4").tobytes() for s in split]


_OPEN: dict[str, PieceIds] = {}


def ids_of(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to token ids (little-endian, 32 bits), with a table kept for the life of the worker."""
    if vocabulary not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _OPEN[vocabulary] = PieceIds(vocabulary)
    return _OPEN[vocabulary].encode


def pieces(docs: DataFrame, vocabulary: str, *, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of documents cut at full sequences."""

    def run(batches):
        encode, row = ids_of(vocabulary), 0
        for b in slices(batches, 1):
            out: list[tuple] = []
            ids = b.column(0).to_pylist()
            for doc_id, data in zip(ids, encode([x or "" for x in b.column(1).to_pylist()])):
                data = memoryview(data + struct.pack("<I", END))
                n = len(data) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    out.append((doc_id, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, row))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


class Tournament:
    """First of ``n`` bins with enough room, by a tree of maxima."""

    def __init__(self, n: int, room: int):
        self.base = 1 << max(0, (n - 1).bit_length())
        self.tree = [room] * (2 * self.base)

    def place(self, size: int) -> int:
        tree, at = self.tree, 1
        if tree[1] < size:
            raise ValueError("no bin has room")
        while at < self.base:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        found = at - self.base
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; items in decreasing order, ties in the given one."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    tree, filled = Tournament(max(1, len(sizes)), capacity), {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.place(sizes[i])
        offsets[i] = filled.get(bins[i], 0)
        filled[bins[i]] = offsets[i] + sizes[i]
    return bins, offsets


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(parts: DataFrame, *, length: int = LENGTH, group_size: int = GROUP) -> DataFrame:
    """Pieces with their sequence and offset. ``parts`` is what ``pieces`` returns."""
    parts = stage(parts, "pack-pieces")
    groups = max(1, -(-parts.count() // group_size))

    def run(key: tuple[np.int64, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "row"], kind="stable", na_position="first")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), length)
        pdf["sequence_id"] = (int(key[0]) << 32) + np.array(bins, np.int64)
        pdf["offset"] = np.array(offsets, np.int64)
        return pdf.drop(columns=["row", "grp"])

    dealt = parts.withColumn("grp", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "start", "row"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(run, SCHEMA)


def op6_ffd_packing(spark, sf_dir):
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
