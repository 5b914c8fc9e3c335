import zlib
from collections import defaultdict

import numpy as np
import pytest

from trailmark.llm import packing

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, and It's don't we'll 'S.", "", None, "été naïve ÀÉ ßtraße ª º µ ¼ ² x²", "tab\tnew\nline\x0bv\xa0nbsp\x85", "\x1c odd \x1e marks", "<|endoftext|> inside", "日本語 ΟΔΟΣ İstanbul", "12ab ab12 3.14 !!??''s",
    "é combining", "word " * 5000, "x" * 3000, "Plain words, and It's don't we'll 'S.",
]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [1]


def test_shortcut_gives_the_tokenizers_ids():
    encode = packing.ids_of(VOCABULARY)
    for text, data in zip(TEXTS, encode([t or "" for t in TEXTS])):
        assert np.frombuffer(data, "<u4").tolist() + [1] == whole(text), text


def test_tournament_is_first_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 400).tolist()
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((j for j, r in enumerate(room) if r >= sizes[i]), None)
        if at is None:
            room.append(100)
            at = len(room) - 1
        want.append((i, at, 100 - room[at]))
        room[at] -= sizes[i]
    assert [(bins[i], offsets[i]) for i, *_ in want] == [(b, o) for _, b, o in want]


@pytest.mark.parametrize("group", [4, 8192])
def test_pieces_cover_documents_and_sequences(spark, group):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "", 2)], "doc_id long, text string, row string, length int")
    rows = packing.pack(packing.pieces(docs, VOCABULARY), group_size=group).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in [*enumerate(TEXTS), (None, "no id")]:
        ids, at = np.array(whole(text), "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(packing.pieces(docs.where("false"), VOCABULARY)).collect() == []
