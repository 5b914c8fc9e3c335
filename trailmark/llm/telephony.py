"""Telephony audio columns: companded and ADPCM samples in, resampled PCM out.

A media column holds one RIFF/WAVE file per row. ``encode_payloads`` stores any
bytes losslessly: as mu-law or A-law samples (every byte is a code, so the data
chunk *is* the payload), or as the nibbles of IMA ADPCM blocks (every nibble is a
code; a block is its head and 64 bytes of payload). Without a fixed kind the
payload's CRC-32 chooses one of the three. ``store`` writes the files as a table
in the shared folder. ``decode_media`` reads such files, expands codes by table
lookup, decodes the ADPCM blocks of all rows of a batch side by side, resamples
the 16-bit PCM and returns it as a column beside digests and features; the caller
stores it, and the query takes its digest.

Both run row by row inside a task: no shuffle, nothing kept between rows, and
a lost executor costs only its running tasks. Arrow batches are cut by bytes,
so that very long rows do not pile up; a single text takes some 40 times its
bytes while it is resampled.

Defined results: a null or empty text is an empty payload, which is padded to
one unit of 64 zero bytes; equal texts give equal files and features; repeated
rows are computed each; an empty table gives an empty result; other columns of
the input are not read. A media value that is no readable WAVE file gives null
features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.shared import lean, stage, table

UNIT = 64
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
BATCH_BYTES = 4 << 20

# Fixed values of the IMA ADPCM format: step sizes and index moves.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
], np.int64)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)


def mulaw_table() -> np.ndarray:
    """16-bit value of each of the 256 mu-law codes."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each of the 256 A-law codes."""
    code = np.arange(256) ^ 0x55
    step, part = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(step == 0, part + 8, part + 0x108 << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
KINDS = (MULAW, ALAW, IMA)


def wav(data: bytes, kind: int, rate: int, samples: int, block: int = 1, bits: int = 8, extra: bytes = b"") -> bytes:
    fmt = struct.pack("<HHIIHHH", kind, 1, rate, rate * block // max(1, samples_of(kind, block)), block, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(kind: int, block: int) -> int:
    return (block - 4) * 2 + 1 if kind == IMA else 1


def parse_wav(media: bytes) -> dict | None:
    """kind, rate, block and data of a WAVE file; None if it is not one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, out = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            out["kind"], _, out["rate"], _, out["block"], out["bits"] = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"fact" and size >= 4:
            out["samples"] = struct.unpack_from("<I", media, at + 8)[0]
        elif name == b"data":
            out["data"] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return out if "kind" in out and "data" in out else None


def ima_encode(pcm: np.ndarray, block: int = 256) -> bytes:
    """IMA ADPCM blocks of 16-bit samples, all blocks encoded side by side."""
    per = samples_of(IMA, block)
    n = max(1, -(-len(pcm) // per))
    x = np.zeros((n, per), np.int64)
    x.flat[: len(pcm)] = pcm
    value, index = x[:, 0].copy(), np.zeros(n, np.int64)
    codes = np.zeros((n, per - 1), np.uint8)
    for t in range(1, per):
        step = IMA_STEPS[index]
        gap = x[:, t] - value
        size = np.minimum(7, np.abs(gap) * 4 // step)
        value, index = _ima_step(value, index, size, gap < 0)
        codes[:, t - 1] = size | np.where(gap < 0, 8, 0)
    head = np.zeros((n, 4), np.uint8)
    head[:, :2] = x[:, :1].astype("<i2").view(np.uint8).reshape(n, 2)
    return np.hstack([head, codes[:, ::2] | codes[:, 1::2] << 4]).tobytes()


def _ima_step(value, index, size, negative):
    step = IMA_STEPS[index]
    move = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
    value = np.clip(value + np.where(negative, -move, move), -32768, 32767)
    return value, np.clip(index + IMA_MOVES[size], 0, 88)


def ima_decode(data: bytes, block: int) -> np.ndarray:
    """PCM of IMA ADPCM blocks; one numpy step per sample position for all blocks."""
    if block <= 4:
        return np.zeros(0, np.int16)
    n = len(data) // block
    raw = np.frombuffer(data, np.uint8, n * block).reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(raw[:, 2], 88).astype(np.int64)
    out = np.empty((n, samples_of(IMA, block)), np.int16)
    out[:, 0] = value
    for t in range(1, out.shape[1]):
        code = raw[:, 4 + (t - 1) // 2] >> (4 * ((t - 1) % 2)) & 15
        value, index = _ima_step(value, index, (code & 7).astype(np.int64), code & 8 > 0)
        out[:, t] = value
    return out.reshape(-1)


def ima_store(payload: bytes) -> bytes:
    """A padded payload as the nibbles of ADPCM blocks that start from silence."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return np.hstack([np.zeros((len(units), 4), np.uint8), units]).tobytes()


def payload_of(found: dict) -> bytes:
    """The bytes that a parsed file stores: its samples, or its blocks without their heads."""
    if found["kind"] != IMA or found["block"] <= 4:
        return found["data"]
    n = len(found["data"]) // found["block"]
    return np.frombuffer(found["data"], np.uint8, n * found["block"]).reshape(n, found["block"])[:, 4:].tobytes()


def expand_all(files: list[dict | None]) -> list[np.ndarray | None]:
    """16-bit PCM of parsed files; ADPCM blocks of one size are decoded together."""
    out = [None if f is None or f["kind"] == IMA else expand(f) for f in files]
    blocks: dict[int, list[int]] = {}
    for i, f in enumerate(files):
        if f is not None and f["kind"] == IMA:
            blocks.setdefault(f["block"], []).append(i)
    for size, rows in blocks.items():
        whole = [len(files[i]["data"]) // size * size if size else 0 for i in rows]
        pcm = ima_decode(b"".join(files[i]["data"][:n] for i, n in zip(rows, whole)), size)
        at = 0
        for i, n in zip(rows, whole):
            samples = n // size * samples_of(IMA, size) if size > 4 else 0
            out[i] = pcm[at : at + min(samples, files[i].get("samples", samples))]
            at += samples
    return out


def expand(found: dict) -> np.ndarray | None:
    """16-bit PCM of a parsed file; None for a format that is not telephony."""
    if found["kind"] in TABLES:
        return TABLES[found["kind"]][np.frombuffer(found["data"], np.uint8)]
    if found["kind"] == IMA:
        pcm = ima_decode(found["data"], found["block"])
        return pcm[: found.get("samples", len(pcm))]
    if found["kind"] == PCM and found["bits"] == 16:
        return np.frombuffer(found["data"], "<i2", len(found["data"]) // 2)
    return None


def resample(pcm: np.ndarray, rate: int, to: int, taps: int = 4) -> np.ndarray:
    """Windowed-sinc polyphase resampling of 16-bit PCM by a rational factor."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    reach = taps * max(1.0, down / up)
    side = int(np.ceil(reach))
    n = -(-len(pcm) * up // down)
    padded = np.pad(pcm.astype(np.float64), side, mode="edge")
    out = np.empty(n)
    for phase in range(min(up, n)):
        k = np.arange(phase, n, up)
        whole, part = (k * down) // up, ((phase * down) % up) / up
        at = np.arange(-side + 1, side + 1) - part
        kernel = np.sinc(at * min(1.0, up / down)) * np.where(np.abs(at) < reach, 0.5 + 0.5 * np.cos(np.pi * at / reach), 0)
        kernel /= kernel.sum()
        if down == 1:
            full = np.convolve(padded, kernel[::-1], "valid")
            out[k] = full[1 : 1 + len(k)]
        else:
            out[k] = sum(w * padded[whole + side + o] for w, o in zip(kernel, range(-side + 1, side + 1)))
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def describe(kind: int, pcm: np.ndarray) -> str:
    """Integer features of the expanded signal."""
    x = pcm.astype(np.int64)
    return f"kind={kind};samples={len(x)};peak={np.abs(x).max(initial=0)};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))}"


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of about ``most`` bytes of one column."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64, batch.num_rows + 1, 8 * batch.column(column).offset) if batch.num_rows else np.zeros(1, np.int64))
        start, total = 0, 0
        for i, size in enumerate(sizes):
            total += int(size)
            if total >= most:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def pad(payload: bytes) -> bytes:
    return payload + b"\0" * (UNIT - len(payload) % UNIT if len(payload) % UNIT or not payload else 0)


def encode_payloads(docs: DataFrame, *, kind: int | None = None, rate: int = 8000) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded UTF-8 bytes as a telephony WAVE file."""
    if kind not in (None, MULAW, ALAW, IMA):
        raise ValueError("only mu-law, A-law and ADPCM codes store bytes losslessly")

    def one(payload: bytes) -> bytes:
        own = kind or KINDS[zlib.crc32(payload) % len(KINDS)]
        if own == IMA:
            per = samples_of(IMA, UNIT + 4)
            return wav(ima_store(payload), IMA, rate, len(payload) // UNIT * per, UNIT + 4, 4, struct.pack("<H", per))
        return wav(payload, own, rate, len(payload))

    def run(batches):
        for b in slices(batches, 1):
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([one(pad(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def store(media: DataFrame) -> DataFrame:
    """The media table, written to the shared folder and read back."""
    return stage(media, "media", compression="zstd")


def decode_media(media: DataFrame, *, rate: int = 16000) -> DataFrame:
    """Digests and features of the stored files, with their PCM at ``rate``.

    Reads doc_id, n_bytes and media; returns doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature and pcm.
    """
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64()}
    kinds |= {"media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pcm": pa.binary()}

    def one(blob: bytes | None, found: dict | None, pcm: np.ndarray | None) -> tuple:
        digest = (None, None) if blob is None else (len(blob), hashlib.sha256(blob).hexdigest())
        if found is None:
            return None, None, None, *digest, None, None
        data = payload_of(found)
        out = None if pcm is None else resample(pcm, found["rate"], rate).astype("<i2").tobytes()
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), *digest, None if pcm is None else describe(found["kind"], pcm), out

    def run(batches):
        for b in slices(batches, 2):
            blobs = b.column(2).to_pylist()
            files = [parse_wav(x) if x is not None else None for x in blobs]
            rows = [one(*x) for x in zip(blobs, files, expand_all(files))]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate([*kinds.values()][2:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], [*kinds])

    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'binary' if k == pa.binary() else 'long'}" for n, k in kinds.items())
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), schema)


def op3_telephony_media(spark, sf_dir):
    found = decode_media(store(encode_payloads(table(spark, sf_dir, "documents"))))
    sound = F.concat(F.lit(";resampled="), F.expr("octet_length(pcm) div 2"), F.lit(";pcm_crc32="), F.crc32("pcm"))
    return found.withColumn("feature", F.concat("feature", sound)).drop("pcm")
