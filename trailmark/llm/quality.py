"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

A document is a bag of hashed features: words, pairs of neighbouring words,
the shapes of words (letter case, digits and attached marks) and pairs of
shapes, with one shared feature for a word that repeats its neighbour. Each
kind is weighted by its share of the text, so the score does not depend on the
length. Weights are learnt per coordinate by the follow-the-regularised-leader
update; a score is the logistic of one sparse dot product, computed over whole
texts in Arrow batches without a shuffle.

Training reads at most ``bound`` labelled rows outside the hold-out; only the
text enters a score. The model (2**bits floats) is what tasks receive.

Defined results: a null, empty or blank text has no features and gets the
logistic of the bias; rows of one id are scored each; a null id is scored and
counts as the text "null" for the hold-out; with no labels at all every score
is 0.5; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.labelled import fit, held_out, sample
from trailmark.llm.shared import lean, table
from trailmark.llm.telephony import slices

BITS, BOUND = 18, 8000
MASK = np.uint64((1 << BITS) - 1)
GAIN = 6.0
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordCodes(dict):
    """word -> 32 bits of its letters and 16 bits of its shape, kept for words seen often."""

    MOST = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        core = re.sub(r"[\W_]+", "", word.lower())
        letters = re.sub(r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "b" if m[0][:1].isupper() else "a", word)
        shape = re.sub(r"\d+", "0", letters)
        code = self[word] = zlib.crc32(core.encode()) << 16 | zlib.crc32(shape.encode()) & 0xFFFF
        return code


CODES = WordCodes()  # lives as long as its worker


def features(words: list[str], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features (indices may repeat; values add up)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    code = np.array([codes[w] for w in words], np.uint64)
    core, shape = code >> np.uint64(16), code & np.uint64(0xFFFF)
    parts = [core * K1, shape * K2]
    if len(code) > 1:
        same = core[1:] == core[:-1]
        parts += [np.where(same, K3, core[:-1] * K1 + core[1:] * K3), shape[:-1] * K3 + shape[1:] * K2 + np.uint64(1)]
    at = [((p ^ p >> np.uint64(29)) * K2 >> np.uint64(31) & MASK).astype(np.int64) for p in parts]
    return np.concatenate(at), np.concatenate([np.full(len(a), GAIN / len(a)) for a in at])


class Ftrl:
    """Follow-the-regularised-leader, proximal form, with per-coordinate rates."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(texts: list[str], labels: list[int], rounds: int = 4) -> bytes:
    """float32 weights; the last is the bias. Both classes carry equal weight."""
    model, codes = Ftrl((1 << BITS) + 1), WordCodes()
    rows = []
    for text, label in zip(texts, labels):
        at, x = features(text.split(), codes)
        at, where = np.unique(at, return_inverse=True)
        rows.append((np.append(at, 1 << BITS), np.append(np.bincount(where, x, len(at)), 1.0).astype(np.float64), label))
    share = np.mean(labels) if labels else 0.5
    weight = {1: 0.5 / max(share, 1e-3), 0: 0.5 / max(1 - share, 1e-3)}
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            model.learn(at, x, y, weight[y])
    return model.weights(slice(None)).astype(np.float32).tobytes()


def score_text(text: str, weights: np.ndarray, codes: WordCodes) -> float:
    at, x = features(text.split(), codes)
    return float(1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -35, 35))))


def fit_quality(docs: DataFrame, labels: DataFrame, *, bound: int = BOUND) -> bytes:
    return fit(sample(docs, labels, "quality", held_out(4, 2), bound, per_class=True), train)


def score_quality(docs: DataFrame, model: bytes, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        weights, codes = np.frombuffer(model, np.float32).astype(np.float64), CODES
        for b in slices(batches, 2):
            scores = [score_text(x or "", weights, codes) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: bytes, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    at = docs.columns.index("text")

    def run(batches):
        weights = np.frombuffer(model, np.float32).astype(np.float64)
        for b in slices(batches, at):
            yield b.filter(pa.array([score_text(x or "", weights, CODES) >= threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_quality_ftrl(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
