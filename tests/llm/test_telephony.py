import hashlib
import zlib

import numpy as np
import pytest

from trailmark.llm import telephony as t


def test_tables_expand_to_the_known_extremes():
    assert t.TABLES[t.MULAW][0] == -32124 and t.TABLES[t.MULAW][0x80] == 32124 and t.TABLES[t.MULAW][0xFF] == 0
    assert t.TABLES[t.ALAW][0x2A] == -32256 and t.TABLES[t.ALAW][0xAA] == 32256 and t.TABLES[t.ALAW][0xD5] == 8
    assert len(set(t.TABLES[t.ALAW].tolist())) == 256


def test_adpcm_blocks_decode_together_as_alone():
    x = (8000 * np.sin(np.arange(3000) / 9)).astype(np.int16)
    blob = t.ima_encode(x)
    both = t.ima_decode(blob, 256)
    assert np.array_equal(both, np.concatenate([t.ima_decode(blob[i : i + 256], 256) for i in range(0, len(blob), 256)]))
    assert np.abs(both[: len(x)].astype(int) - x).mean() < 400
    file = t.wav(blob, t.IMA, 8000, len(x), 256, 4)
    assert np.array_equal(t.expand(t.parse_wav(file)), both[: len(x)])


@pytest.mark.parametrize("to", [16000, 12000, 4000])
def test_resampling_keeps_a_tone(to):
    x = (9000 * np.sin(2 * np.pi * 300 * np.arange(4000) / 8000)).astype(np.int16)
    y = t.resample(x, 8000, to)
    assert len(y) == 4000 * to // 8000
    want = 9000 * np.sin(2 * np.pi * 300 * np.arange(len(y)) / to)
    assert np.abs(y - want)[50:-50].max() < 300


def scalar_pcm(media):
    """(kind, payload, samples at 8 kHz) of a file, one sample at a time and by the formulas of the formats."""
    kind, size = int.from_bytes(media[20:22], "little"), int.from_bytes(media[32:34], "little")
    at = media.index(b"data") + 4
    data = media[at + 4 : at + 4 + int.from_bytes(media[at : at + 4], "little")]
    out, payload = [], b""
    if kind == t.MULAW:
        for c in data:
            c ^= 0xFF
            x = (((c & 15) * 2 + 33) << (c >> 4 & 7)) - 33
            out.append(-4 * x if c >> 7 else 4 * x)
        return kind, data, out
    if kind == t.ALAW:
        for c in data:
            c ^= 0x55
            e, m = c >> 4 & 7, c & 15
            x = (2 * m + 1) * 8 if e == 0 else (2 * m + 33) * 8 << e - 1
            out.append(x if c >> 7 else -x)
        return kind, data, out
    for i in range(0, len(data), size):
        value, index = int.from_bytes(data[i : i + 2], "little", signed=True), data[i + 2]
        payload += data[i + 4 : i + size]
        out.append(value)
        for byte in data[i + 4 : i + size]:
            for code in (byte & 15, byte >> 4):
                step = int(t.IMA_STEPS[index])
                move = step // 8 + step * (code >> 2 & 1) + step // 2 * (code >> 1 & 1) + step // 4 * (code & 1)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
    return kind, payload, out


def plain_feature(media):
    kind, payload, x = scalar_pcm(media)
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    pcm = t.resample(np.array(x, np.int16), 8000, 16000).astype("<i2").tobytes()
    return payload, f"kind={kind};samples={len(x)};peak={max(map(abs, x))};sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings};resampled={2 * len(x)};pcm_crc32={zlib.crc32(pcm)}"


def test_query_equals_brute_force(spark, tmp_path):
    texts = ["", None, "a", "b" * 64, "é" * 40, "long " * 6000, "a", *(f"text {i} " * i for i in range(20))]
    docs = spark.createDataFrame([(i, x, "en", "extra") for i, x in enumerate(texts)], "doc_id long, text string, media string, pcm string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in t.op3_telephony_media(spark, str(tmp_path)).collect()}
    files = {r.doc_id: bytes(r.media) for r in t.encode_payloads(docs).collect()}
    kinds = set()
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        payload, feature = plain_feature(files[i])
        r = rows[i]
        assert payload == padded and (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes == len(files[i]) and r.media_sha256 == hashlib.sha256(files[i]).hexdigest() and r.feature == feature
        kinds.add(feature[:6])
    assert len(kinds) == 3  # mu-law, A-law and ADPCM all occur
    assert rows[2].feature == rows[6].feature and rows[0].media_sha256 == rows[1].media_sha256
    assert t.decode_media(t.encode_payloads(docs.where("false"))).collect() == []


def test_the_query_reads_back_what_lies_in_the_shared_folder(spark):
    plan = t.op3_telephony_media(spark, "/root/testdata/sf0.001")
    assert plan._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert all("/trailmark/" in f for f in plan.inputFiles())


@pytest.mark.parametrize("kind", [t.MULAW, t.ALAW, t.IMA])
def test_each_kind_stores_any_bytes(spark, kind):
    docs = spark.createDataFrame([(1, "".join(map(chr, range(1, 400))))], "doc_id long, text string")
    r = t.decode_media(t.encode_payloads(docs, kind=kind)).collect()[0]
    raw = docs.collect()[0].text.encode()
    assert r.payload_sha256 == hashlib.sha256(t.pad(raw)).hexdigest() and r.feature.startswith(f"kind={kind};") and len(r.pcm) > 2 * len(raw)


def test_unreadable_media_gives_nulls(spark):
    media = spark.createDataFrame([(1, 0, b"RIFFxxxx"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.payload_bytes, r.feature) for r in t.decode_media(media).collect()] == [(None, None)] * 2
