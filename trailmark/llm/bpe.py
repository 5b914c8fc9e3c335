"""Byte-level BPE by speculate and verify, and its decoding.

A text is cut at special tokens and into the vocabulary's pre-tokens ("words").
Words that the task has not met yet are encoded together:

1. *speculate*: a walk through a trie of the vocabulary, from every byte of all
   words at once, finds the longest token there; hops from token to token give
   each word's proposal;
2. *verify*: two adjacent tokens are compatible if byte pair merging would leave
   the border between them alone. The merges that made the tokens are undone from
   the last to the first; if on the way the pieces that touch at the border have a
   merge that ranks before the one just undone, merging would have crossed it. All
   distinct adjacent pairs are tested side by side. A proposal whose adjacent pairs
   are all compatible is the encoding;
3. *repair*: only words with a failing pair are merged exactly, short ones side by
   side, a merge a round, and long ones with a heap.

Nothing is shuffled: a text's ids depend on the text and the vocabulary only. The
walk is windowed, so that a word of any length takes the memory of its bytes.

Pre-tokens come from a pattern of Python's own classes. Where a text has a code
point that these class differently from the tokenizer (another Unicode version,
numbers beyond decimal digits), the text goes through the tokenizer's own splitter.

Defined results: a null text is an empty one, with no ids; rows that repeat an id
are encoded each; a null id is kept; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.shared import lean, table
from trailmark.llm.telephony import slices

NEVER = np.int64(1) << 40
WINDOW = 1 << 20
MOST_WORDS, LONG_WORD = 300_000, 64
SIDE_BY_SIDE = 20_000
SLICE = 2 << 20
# The splitter's pattern of this vocabulary family, in Python's classes.
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))})
    return out


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start..start+size of all spans, one after the other."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return at


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start+size] of all spans, one after the other."""
    return data[places(start, size)]


def sliced(ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Each word's ids, 32 bits each, of ids in a row."""
    data, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(4 * count)]).tolist()
    return [data[a:z] for a, z in zip(at, at[1:])]


class Vocabulary:
    """Tokens, ranked merges and a trie of one byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a byte-level BPE without normalisation, prefix spaces and word ends")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("only plain special tokens are known here")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte_of, vocab = byte_symbols(), model["vocab"]
        n = 1 + max([*vocab.values(), *self.special.values()])
        content: list[bytes] = [b""] * n
        for token, i in vocab.items():
            content[i] = bytes(map(byte_of.__getitem__, token))
        for token, i in self.special.items():
            content[i] = token.encode()
        self.content = content
        self.sizes = np.array([len(c) for c in content], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(content), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for symbol, b in byte_of.items():
            self.byte_id[b] = vocab[symbol]
        self._merges(model["merges"], vocab, n)
        self._trie(vocab)
        digits = [b"%d," % i for i in range(n)]
        self.decimal_sizes = np.array([len(d) for d in digits], np.int64)
        self.decimal_starts = np.cumsum(self.decimal_sizes) - self.decimal_sizes
        self.decimal = np.frombuffer(b"".join(digits), np.uint8)

    def _merges(self, merges: list, vocab: dict[str, int], n: int) -> None:
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        codes = left << 32 | right
        codes, first = np.unique(codes, return_index=True)
        self.codes, self.code_rank, self.merge_made = codes, first.astype(np.int64), made
        self.ranks = dict(zip(codes.tolist(), zip(first.tolist(), made[first].tolist())))
        self.rank = np.full(n, -1, np.int64)
        self.parts = np.full((n, 2), -1, np.int64)
        for i in range(len(pairs) - 1, -1, -1):  # the first merge that makes a token is its own
            self.rank[made[i]], self.parts[made[i]] = i, (left[i], right[i])
        # a token may be proposed if merging its own bytes gives it
        kind = np.flatnonzero(self.rank >= 0)
        kind = kind[np.argsort(self.rank[kind])]
        a, b = self.parts[kind].T
        sound = self.compatible(a, b, self.rank[kind]) & (self.rank[a] < self.rank[kind]) & (self.rank[b] < self.rank[kind])
        self.proper = np.zeros(n, bool)
        self.proper[self.byte_id] = True
        for t, x, y, ok in zip(kind.tolist(), a.tolist(), b.tolist(), sound.tolist()):
            self.proper[t] = ok and self.proper[x] and self.proper[y]

    def _trie(self, vocab: dict[str, int]) -> None:
        edges: dict[int, int] = {}
        token = [-1]
        for i in vocab.values():
            if not self.proper[i]:
                continue
            node = 0
            for b in self.content[i]:
                nxt = edges.get(node << 8 | b)
                if nxt is None:
                    nxt = edges[node << 8 | b] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = i
        self.token = np.array(token, np.int64)
        slots = 1 << (4 * len(edges)).bit_length()
        self.slot_mask = slots - 1
        self.slot_key, self.slot_node = np.full(slots, -1, np.int64), np.full(slots, -1, np.int32)
        keys = np.array(list(edges), np.int64)
        nodes = np.array(list(edges.values()), np.int32)
        at = self._slot(keys)
        while len(keys):  # open addressing: one key a free slot, the rest move on
            free = self.slot_key[at] < 0
            at_free, first = np.unique(at[free], return_index=True)
            self.slot_key[at_free], self.slot_node[at_free] = keys[free][first], nodes[free][first]
            rest = self.slot_key[at] != keys
            keys, nodes, at = keys[rest], nodes[rest], (at[rest] + 1) & self.slot_mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & self.slot_mask

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The trie node behind each node << 8 | byte, or -1."""
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_node[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.slot_mask
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_node[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
        return np.where(self.codes[at] == want, self.code_rank[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves the border between two tokens alone, before merge ``limit``."""
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), NEVER) if limit is None else limit.copy()
        out, live = np.ones(len(left), bool), np.arange(len(left))
        while len(live):
            crossed = self.pair_rank(left[live], right[live]) < limit[live]
            out[live[crossed]] = False
            a, b = self.rank[left[live]], self.rank[right[live]]
            live, a, b = (x[~crossed & ((a >= 0) | (b >= 0))] for x in (live, a, b))
            of_left = a > b
            i, j = live[of_left], live[~of_left]
            limit[i], left[i] = a[of_left], self.parts[left[i], 1]
            # of equal merges the left one comes first, so one that crosses comes before the right one
            limit[j], right[j] = b[~of_left] + 1, self.parts[right[j], 0]
        return out

    def longest(self, data: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The longest token at each byte; ``room``: bytes left in its word."""
        best = np.empty(len(data), np.int64)
        for start in range(0, len(data), WINDOW):
            best[start : start + WINDOW] = self.byte_id[data[start : start + WINDOW]]
            at = np.arange(start, min(start + WINDOW, len(data)))
            node, depth = np.zeros(len(at), np.int64), 0
            while len(at):
                node = self.step(node << 8 | data[at + depth])
                depth += 1
                on = node >= 0
                at, node = at[on], node[on].astype(np.int64)
                token = self.token[node]
                full = token >= 0
                best[at[full]] = token[full]
                on = room[at] > depth
                at, node = at[on], node[on]
        return best

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get(ids[i] << 32 | ids[i + 1])
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = ranks.get(made << 32 | ids[k])
                if found:
                    heapq.heappush(heap, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get(ids[h] << 32 | made)
                if found:
                    heapq.heappush(heap, (found[0], h, ids[h], made, found[1]))
        return [i for i in ids if i >= 0]

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of words of one size class, a merge a word and round."""
        size = np.array([len(w) for w in words], np.int64)
        wide = int(size.max())
        ids = np.full((len(words), wide + 1), -1, np.int64)
        inside = np.arange(wide + 1) < size[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), wide), NEVER)
        both = inside[:, 1:]
        rank[both] = self.pair_rank(ids[:, :-1][both], ids[:, 1:][both])
        live = np.arange(len(words))
        column, columns = np.arange(wide), np.arange(wide + 1)
        while True:
            at = rank[live].argmin(1)  # the leftmost of the lowest
            on = rank[live, at] < NEVER
            live, at = live[on], at[on]
            if not len(live):
                break
            ids[live, at] = self.merge_made[rank[live, at]]
            # the right half goes, with the pair that it began
            ids[live] = np.take_along_axis(ids[live], np.minimum(columns + (columns > at[:, None]), wide), 1)
            rank[live] = np.take_along_axis(rank[live], np.minimum(column + (column > at[:, None]), wide - 1), 1)
            rank[live, wide - 1], ids[live, wide] = NEVER, -1
            for i in (at - 1, at):
                there = (i >= 0) & (ids[live, i + 1] >= 0)
                rows, cols = live[there], i[there]
                rank[rows, cols] = self.pair_rank(ids[rows, cols], ids[rows, cols + 1])
                rank[live[~there & (i >= 0)], i[~there & (i >= 0)]] = NEVER
        return sliced(ids[ids >= 0], (ids >= 0).sum(1))

    def exact(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words: short ones side by side, long ones with a heap."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        low = 0
        for high in (8, 16, 32, LONG_WORD):
            rows = np.flatnonzero((sizes > low) & (sizes <= high)).tolist()
            for start in range(0, len(rows), SIDE_BY_SIDE):
                chunk = rows[start : start + SIDE_BY_SIDE]
                for i, ids in zip(chunk, self.merge_short([words[i] for i in chunk])):
                    out[i] = ids
            low = high
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy tokens of all words in a row, tokens a word, and which words have only compatible pairs."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        best = self.longest(data, np.repeat(end, size) - np.arange(len(data)))
        hop = np.arange(len(data)) + self.sizes[best]
        reached = np.zeros(len(data), bool)
        at, stop = end - size, end
        for _ in range(LONG_WORD):
            on = at < stop
            at, stop = at[on], stop[on]
            if not len(at):
                break
            reached[at] = True
            at = hop[at]
        for a, z in zip(at.tolist(), stop.tolist()):  # the few words of many tokens
            while a < z:
                reached[a] = True
                a = int(hop[a])
        where = np.flatnonzero(reached)
        ids = best[where]
        word = np.searchsorted(end, where, side="right")
        count = np.bincount(word, minlength=len(words))
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[inside] << 32 | ids[inside + 1], return_inverse=True)
        fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        sound = np.ones(len(words), bool)
        sound[word[inside[fails]]] = False
        return ids, count, sound


class Codec:
    """Texts to ids and back, with a bounded table of words for the life of the worker."""

    def __init__(self, vocabulary: str):
        self.v = Vocabulary(vocabulary)
        self.words: dict[str, bytes] = {}
        self.same: set[str] = set()  # code points on which both splitters agree
        self.other: set[str] = set()
        self.proposed = self.repaired = 0

    def odd(self, text: str) -> bool:
        if text.isascii() and not re.search("[\x1c-\x1f]", text):
            return False
        points = set(text)
        for c in points - self.same - self.other:
            probe = f"a{c}1{c}!{c} {c}  x\n{c}_"
            agrees = [m.span() for m in WORDS.finditer(probe)] == [span for _, span in self.v.splitter.pre_tokenize_str(probe)]
            (self.same if agrees else self.other).add(c)
        return not self.other.isdisjoint(points)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens stand between them."""
        out: list[str] = []
        for i, part in enumerate(self.v.cut.split(text) if self.v.cut else [text]):
            if i % 2:
                out.append(part)
            elif self.odd(part):
                out += [part[a:b] for _, (a, b) in self.v.splitter.pre_tokenize_str(part)]
            else:
                out += WORDS.findall(part)
        return out

    def learn(self, words: list[str]) -> None:
        """Ids of distinct words that are not in the table yet."""
        special = [w for w in words if w in self.v.special]
        ordinary = [w for w in words if w not in self.v.special] if special else words
        for w in special:
            self.words[w] = np.array([self.v.special[w]], "<u4").tobytes()
        if not ordinary:
            return
        raw = [w.encode() for w in ordinary]
        ids, count, sound = self.v.propose(raw)
        self.proposed += len(raw)
        self.words.update(zip(ordinary, sliced(ids, count)))
        failing = np.flatnonzero(~sound).tolist()
        self.repaired += len(failing)
        self.words.update(zip([ordinary[i] for i in failing], self.v.exact([raw[i] for i in failing])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and ids a text."""
        out, count = [], np.zeros(len(texts), np.int64)
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        split = [self.split(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.words))
        self.learn(new)
        for i, s in enumerate(split):
            ids = b"".join(map(self.words.__getitem__, s))
            count[i] = len(ids) // 4
            out.append(ids)
        for w in new:
            if len(w) > LONG_WORD:
                del self.words[w]
        return np.frombuffer(b"".join(out), "<u4").astype(np.int64), count

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, special ones included; what is no UTF-8 becomes U+FFFD."""
        data = gather(self.v.blob, self.v.starts[ids], self.v.sizes[ids]).tobytes()
        return data.decode("utf-8", "replace").encode()

    def decimal(self, ids: np.ndarray) -> bytes:
        return gather(self.v.decimal, self.v.decimal_starts[ids], self.v.decimal_sizes[ids]).tobytes()[:-1]


_OPEN: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _OPEN:
        _OPEN[vocabulary] = Codec(vocabulary)
    return _OPEN[vocabulary]


def encode_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids: each text's token ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in slices(batches, 1, SLICE):
            ids, count = coder.encode([t or "" for t in b.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of what ``encode_texts`` returns; null ids are an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in batches:
            texts = [coder.decode(np.array(x or [], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in slices(batches, 1, SLICE):
            ids, count = coder.encode([t or "" for t in b.column(1).to_pylist()])
            parts = np.split(ids, np.cumsum(count)[:-1])
            columns = [
                b.column(0),
                pa.array(count, pa.int64()),
                pa.array([hashlib.sha256(coder.decimal(p)).hexdigest() for p in parts], pa.string()),
                pa.array([hashlib.sha256(coder.decode(p)).hexdigest() for p in parts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_speculative_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
