import hashlib
import json
import random

import numpy as np
import pytest

from trailmark.llm import bpe

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")
TEXTS = [
    "Plain words, and It's don't we'll 'S.", "", None, " ", "\n\n  \t x", "été naïve ÀÉ ßtraße ª º µ ¼ ² x²", "tab\tnew\nline\x0bv\xa0nbsp\x85 \x1c odd \x1e marks", "日本語 ΟΔΟΣ İstanbul 👩‍👩‍👧",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|> \n<|endoftext|>c", "<|endoftext", "12ab ab12 3.14 ٣٤ Ⅷ !!??''s'ss", "՘ ࢏౜ new letters", "é combining", "word " * 3000, "x" * 3000, "ab" * 2500 + "é" * 500,
    "_" * 300 + "=" * 77 + " " * 500 + "-", " 　​", "".join(map(chr, range(1, 400))), "'ll 're 'x ''''ve",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def rebuilt(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_rows_are_the_librarys(spark, library):
    docs = spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, ""), (3, "same id", 1, "")], "doc_id long, text string, n_tokens int, ids string")
    got = sorted(bpe.round_trip(docs.repartition(3), FILE).collect(), key=str)
    want = sorted([(i, *digests(library, t)) for i, t in [*enumerate(TEXTS), (None, "no id"), (3, "same id")]], key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip(docs.where("false"), FILE).collect() == []


def test_ids_and_texts_as_columns(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = bpe.encode_texts(docs, FILE)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in bpe.decode_ids(ids, FILE).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, [447, 220]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_ids(odd, FILE).collect()} == {1: library.decode([447, 220], skip_special_tokens=False), 2: ""}


def test_random_words_of_few_letters(library):
    rng, coder = random.Random(5), bpe.codec(FILE)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for letters in ["ab", "thes ", "-= ", "aé日\n", "01 ", "'stve "] for _ in range(400)]
    ids, count = coder.encode(texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_both_forms_of_exact_merging_agree():
    rng, v = random.Random(6), bpe.codec(FILE).v
    words = ["".join(rng.choice("thesrin aeo") for _ in range(rng.randint(1, 64))).encode() for _ in range(1500)] + [b"the" * 40]
    assert [rebuilt(x) for x in v.exact(words)] == [v.merge(w) for w in words]


def test_only_failing_words_are_merged_and_sound_ones_are_right():
    rng, v = random.Random(7), bpe.codec(FILE).v
    words = ["".join(rng.choice("thesrinaeo") for _ in range(rng.randint(2, 12))).encode() for _ in range(3000)]
    ids, count, sound = v.propose(words)
    for w, greedy, ok in zip(words, np.split(ids, np.cumsum(count)[:-1]), sound):
        assert ok == (greedy.tolist() == v.merge(w)), w
    assert 0.1 < sound.mean() < 0.9


def test_pairs_are_compatible_if_merging_keeps_their_border():
    rng, v = np.random.default_rng(8), bpe.codec(FILE).v
    a, b = rng.integers(0, 4000, 3000), rng.integers(0, 4000, 3000)
    for x, y, ok in zip(a.tolist(), b.tolist(), v.compatible(a, b)):
        assert ok == (v.merge(v.content[x] + v.content[y]) == [x, y])


def test_windows_do_not_cut_tokens(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 3)
    v = bpe.codec(FILE).v
    words = [b" information", b"================", b" the"]
    ids, count, _ = v.propose(words)
    assert ids.tolist() == [v.merge(w)[0] for w in words] and count.tolist() == [1, 1, 1]


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    with open(FILE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))
