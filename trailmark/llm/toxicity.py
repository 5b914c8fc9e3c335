"""Toxicity: a linear-chain conditional random field over words.

Labels are given for documents, so the words that the field learns from are
labelled first: over the training sample, words and word beginnings that occur
almost only in toxic documents are cues, and in a toxic document the words
that bear a cue are labelled offending; all other words are not. The field
(two states; weights for a word, its beginnings and its ending, and for the
four transitions) is fitted by gradient ascent on the conditional likelihood.

Forward-backward gives each word's marginal. A document's score is a logistic
function, fitted on the training sample, of the sum, the mean and the largest
of its marginals; the offsets of words above one half are its toxic spans.
Recursions run over all documents of a batch at once, sorted by length.

Training reads at most ``bound`` labelled rows outside the hold-out; only the
text enters a score. The model is a table of fixed size (2**bits floats), which
tasks receive; scoring needs no shuffle.

Defined results: a null, empty or blank text scores as one without offending
words; rows of one id are scored each; a null id is scored and counts as the
text "null" for the hold-out; with no labels every text scores the same; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.labelled import fit, held_out, sample
from trailmark.llm.shared import lean, table
from trailmark.llm.telephony import slices

BITS, BOUND = 20, 6000
SIZE = 1 << BITS
WINDOW, CELLS, CLEAN_SHARE = 64, 1 << 20, 0.1
HEAD = 4 + 6  # transitions 00 01 10 11, then bias and weights of the document's score
WORD = re.compile(r"[^\W\d_]+")


def traits(word: str) -> list[int]:
    """Fingerprints of the letters of a word, its beginnings and its ending."""
    core = word.lower()
    parts = ["=" + core, "$" + core[-3:], *(core[:n] for n in range(3, min(7, len(core)) + 1))]
    return [zlib.crc32(t.encode()) for t in parts]


class WordScores(dict):
    """word -> its emission score, kept for words seen often."""

    MOST = 900_000

    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= self.MOST:
            self.clear()
        w = self.weights
        score = self[word] = sum([w[t & SIZE - 1] for t in traits(word)])
        return score


_OPEN: dict[int, tuple] = {}


def opened(model: bytes) -> tuple:
    """Transitions, document weights and word scores of a model, kept for the life of the worker."""
    key = hash(model)
    if key not in _OPEN:
        _OPEN.clear()
        values = np.frombuffer(model, np.float32).astype(np.float64)
        _OPEN[key] = values[:4].reshape(2, 2), values[4:9], WordScores(values[HEAD:])
    return _OPEN[key]


def marginals(emission: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """P(offending) of every position of every sequence, sequences of like length side by side."""
    out: list[np.ndarray] = [np.zeros(0)] * len(emission)
    order = sorted(range(len(emission)), key=lambda i: -len(emission[i]))
    while order and len(emission[order[-1]]) == 0:
        order.pop()
    at = 0
    while at < len(order):
        n = max(1, min(len(order) - at, CELLS // len(emission[order[at]])))
        some = order[at : at + n]
        for i, p in zip(some, side_by_side([emission[i] for i in some], moves)):
            out[i] = p
        at += n
    return out


def side_by_side(emission: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Marginals of sequences in decreasing length, by messages kept as log odds."""
    lengths = np.array([len(e) for e in emission])
    n, most = len(lengths), int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(most), "left")  # sequences longer than t
    e = np.zeros((most, n))
    for i, x in enumerate(emission):
        e[: len(x), i] = x

    # log odds after a move: log(e^(m01) + e^(o + m11)) - log(e^(m00) + e^(o + m10))
    def step(odds, to):
        return np.logaddexp(to[0, 1], odds + to[1, 1]) - np.logaddexp(to[0, 0], odds + to[1, 0])

    ahead, back = np.zeros((most, n)), np.zeros((most, n))
    for t in range(most):
        k = alive[t]
        ahead[t, :k] = e[t, :k] + (step(ahead[t - 1, :k], moves) if t else 0.0)
    for t in range(most - 2, -1, -1):
        k = alive[t + 1]
        back[t, :k] = step(e[t + 1, :k] + back[t + 1, :k], moves.T)
    p = 1 / (1 + np.exp(-np.clip(ahead + back, -35, 35)))
    return [p[:m, i] for i, m in enumerate(lengths)]


class Vocabulary:
    """Words as numbers, with their traits in one flat array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def read(self, text: str) -> np.ndarray:
        out = array("i")
        for w in WORD.findall(text):
            i = self.number.get(w)
            if i is None:
                i = self.number[w] = len(self.number)
                self.flat.extend(traits(w))
                self.ends.append(len(self.flat))
            out.append(i)
        return np.array(out, np.int32)

    def close(self) -> None:
        self.codes, self.at = np.array(self.flat, np.uint32), np.array(self.ends)
        self.number, self.flat, self.ends = {}, array("I"), array("q")

    def traits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Traits of the words in turn, and the position of the word each belongs to."""
        n = self.at[words + 1] - self.at[words]
        owner = np.repeat(np.arange(len(words)), n)
        return self.codes[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + self.at[words][owner]], owner


def cues(known: Vocabulary, docs: list[np.ndarray], labels: list[int], least: int = 4, purity: float = 0.9) -> np.ndarray:
    """Traits, sorted, that occur almost only in toxic documents, in ``least`` of them or more."""
    counts = []
    for y in (1, 0):
        seen = [np.unique(known.traits(np.unique(d))[0]) for d, label in zip(docs, labels) if label == y]
        counts.append(np.unique(np.concatenate([np.zeros(0, np.uint32), *seen]), return_counts=True))
    (toxic, n), (clean, m) = counts
    share = max(1, sum(1 - y for y in labels)) / max(1, sum(labels))  # so that both classes weigh the same
    at = np.minimum(np.searchsorted(clean, toxic), max(0, len(clean) - 1))
    other = np.where(clean[at] == toxic, m[at], 0) if len(clean) else np.zeros(len(toxic))
    return toxic[(n >= least) & (n * share >= purity * (n * share + other)) & (other <= np.maximum(1, n // 8))]


def summary(p: np.ndarray) -> np.ndarray:
    """What a document's score sees of its marginals."""
    if not len(p):
        return np.zeros(4)
    s = float(np.where(p > 0.05, p, 0).sum())
    return np.array([np.log1p(s), min(s, 3.0), float(p.max()), np.log1p(1000 * s / len(p)) / 4])


def train(texts: list[str], labels: list[int], rounds: int = 8, rate: float = 0.3, clean_share: float = CLEAN_SHARE) -> bytes:
    """float32: 4 transitions, 6 numbers of the document's score, SIZE emissions.

    Of the sample's windows without an offending word the share ``clean_share`` is learnt from.
    """
    model = np.zeros(HEAD + SIZE, np.float32)
    if not texts:
        return model.tobytes()
    known = Vocabulary()
    docs = [known.read(t) for t in texts]
    known.close()
    found = cues(known, docs, labels)
    hit = np.add.reduceat(np.append(np.isin(known.codes, found), False).astype(np.int64), known.at[:-1]) > 0 if len(known.codes) else np.zeros(0, bool)
    rng = np.random.default_rng(11)
    windows = []
    for doc, y in zip(docs, labels):
        tags = hit[doc].astype(np.int64) * y
        for a in range(0, len(doc), WINDOW):
            # of windows without an offending word a fixed share is enough to learn from
            if tags[a : a + WINDOW].any() or rng.random() < clean_share:
                windows.append((doc[a : a + WINDOW], tags[a : a + WINDOW]))
    weights, squares = np.zeros(SIZE), np.full(SIZE, 1e-8)
    moves, moves_sq = np.zeros((2, 2)), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), 256):
            batch = [windows[i] for i in order[start : start + 256]]
            flat, owner = known.traits(np.concatenate([w for w, _ in batch]))
            flat = (flat & np.uint32(SIZE - 1)).astype(np.int64)
            e = np.bincount(owner, weights[flat], owner[-1] + 1)
            emission = np.split(e, np.cumsum([len(w) for w, _ in batch])[:-1])
            p = marginals(emission, moves)
            gap = np.concatenate([t for _, t in batch]) - np.concatenate(p)
            at, where = np.unique(flat, return_inverse=True)
            g = np.bincount(where, gap[owner] / len(batch), len(at)) - 1e-5 * weights[at]
            squares[at] += g * g
            weights[at] += rate * g / np.sqrt(squares[at])
            want, have = np.zeros((2, 2)), np.zeros((2, 2))
            for (_, t), em in zip(batch, emission):
                if len(t) > 1:
                    np.add.at(want, (t[:-1], t[1:]), 1)
                    have += expected(em, moves)
            g = (want - have) / len(batch) - 1e-3 * moves
            moves_sq += g * g
            moves += 0.3 * rate * g / np.sqrt(moves_sq)
    slots = (known.codes & np.uint32(SIZE - 1)).astype(np.int64)
    sums = np.concatenate([[0.0], np.cumsum(weights[slots])])
    score = sums[known.at[1:]] - sums[known.at[:-1]]
    x = np.array([summary(q) for a in range(0, len(docs), 500) for q in marginals([score[d] for d in docs[a : a + 500]], moves)])
    y = np.array(labels, float)
    head = np.zeros(5)
    x = np.hstack([np.ones((len(x), 1)), x])
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ head, -35, 35)))
        hessian = (x * (balance * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(5)
        head += np.linalg.solve(hessian, x.T @ (balance * (y - q)) - 0.05 * head)
    model[:4], model[4:9], model[HEAD:] = moves.ravel(), head, weights
    return model.tobytes()


def expected(emission: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected transitions of one sequence, from messages of a single pass."""
    n = len(emission)
    ahead, back = np.zeros(n), np.zeros(n)
    m = np.exp(moves)
    e = np.exp(np.clip(emission, -30, 30))
    ahead[0] = e[0]
    for t in range(1, n):
        ahead[t] = e[t] * (m[0, 1] + ahead[t - 1] * m[1, 1]) / (m[0, 0] + ahead[t - 1] * m[1, 0])
    back[n - 1] = 1.0
    for t in range(n - 2, -1, -1):
        o = e[t + 1] * back[t + 1]
        back[t] = (m[1, 0] + o * m[1, 1]) / (m[0, 0] + o * m[0, 1])
    o = e[1:] * back[1:]
    joint = np.array([[np.full(n - 1, m[0, 0]), m[0, 1] * o], [ahead[:-1] * m[1, 0], ahead[:-1] * m[1, 1] * o]])
    return (joint / joint.sum((0, 1))).sum(2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, bound: int = BOUND, clean_share: float = CLEAN_SHARE) -> bytes:
    return fit(sample(docs, labels, "toxic", held_out(5, 0), bound, per_class=True), functools.partial(train, clean_share=clean_share))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,probability:double>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def score_toxicity(docs: DataFrame, model: bytes, *, threshold: float = 0.5, span_threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans in code points."""

    def run(batches):
        moves, head, words = opened(model)
        for b in slices(batches, 2):
            texts = [x or "" for x in b.column(2).to_pylist()]
            p = marginals([np.array(list(map(words.__getitem__, WORD.findall(x)))) for x in texts], moves)
            score = [float(1 / (1 + np.exp(-np.clip(head[0] + head[1:] @ summary(q), -35, 35)))) for q in p]
            spans = [spans_of(x, q, span_threshold) for x, q in zip(texts, p)]
            columns = [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(spans, SPANS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), "text").mapInArrow(lean(run), SCHEMA)


def spans_of(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Runs of neighbouring offending words."""
    hits = np.flatnonzero(p > threshold)
    if not len(hits):
        return []
    bounds = [m.span() for m in WORD.finditer(text)]
    row: list[dict] = []
    for i, before in zip(hits.tolist(), [-2, *hits.tolist()]):
        if row and before == i - 1:
            row[-1] = {"start": row[-1]["start"], "end": bounds[i][1], "probability": max(row[-1]["probability"], float(p[i]))}
        else:
            row.append({"start": bounds[i][0], "end": bounds[i][1], "probability": float(p[i])})
    return row


def op9_toxicity_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))).drop("spans")
