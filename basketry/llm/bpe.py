"""Byte-level BPE encoding by speculation and verification, and decoding.

A text is cut into words by the vocabulary's splitting pattern.  For words not
seen before, greedy longest match proposes tokens; a proposal is the true
encoding exactly when every token encodes to itself and every adjacent pair of
tokens is what merging makes of the pair's own bytes.  Those checks run as
array lookups over all adjacent pairs of a batch of words; a pair met for the
first time is merged once and remembered.  Only words with a failing check
undergo the exact merges.

Work is row-wise, without a shuffle; tables of known words and pairs live in
the Python worker, are bounded, and are dropped and refilled when full.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from basketry.llm import common

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Known words and known pairs kept by one Python worker.
WORDS, PAIRS = 300_000, 500_000
#: Words at least this long are not remembered, and merged with a heap.
LONG = 64
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """Character of a vocabulary file -> byte: visible Latin-1 characters stand
    for themselves, the other bytes for the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tables of a byte-level BPE file, and the encoder with its memory."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        vocab = data["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for b, i in self.ids.items():
            self.bytes[i] = b
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.merges = {}
        for rank, m in enumerate(data["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = {rank: new for rank, new in self.merges.values()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            self.longest[b[:3]] = max(self.longest.get(b[:3], 1), len(b))
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.alone = np.zeros(len(self.bytes), np.int8)  # 0 not known, 1 holds, 2 fails

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: the merge of lowest rank first, leftmost first."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n < LONG:
            return self.merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap = []
        for i in range(n - 1):
            m = get((ids[i], ids[i + 1]))
            if m:
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # an earlier merge took one side
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = get((new, ids[k]))
                if m:
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            h = before[i]
            if h >= 0:
                m = get((ids[h], new))
                if m:
                    heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [t for t in ids if t >= 0]

    def merge_short(self, ids: list[int]) -> list[int]:
        rank = self.ranks.get
        r = [rank(pair, NEVER) for pair in zip(ids, ids[1:])]
        while r:
            low = min(r)
            if low == NEVER:
                break
            i = r.index(low)  # the leftmost of the lowest rank
            ids[i] = self.made[low]
            del ids[i + 1], r[i]
            if i < len(r):
                r[i] = rank((ids[i], ids[i + 1]), NEVER)
            if i:
                r[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
        return ids

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        get, longest, out, i, n = self.ids.get, self.longest.get, [], 0, len(word)
        while i < n:
            j = i + longest(word[i:i + 3], 2)
            t = get(word[i:j])
            while t is None:
                j -= 1
                t = get(word[i:j])
            out.append(t)
            i += len(self.bytes[t])
        return out

    def hold(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per position: the token encodes to itself and is compatible with its
        left neighbour (always so where `first` marks the start of a word)."""
        for t in np.unique(flat[self.alone[flat] == 0]).tolist():
            self.alone[t] = 1 if self.merge(self.bytes[t]) == [t] else 2
        good = self.alone[flat] == 1
        inner = np.flatnonzero(~first)
        codes = (flat[inner - 1] << 20) | flat[inner]
        distinct, where = np.unique(codes, return_inverse=True)
        known = self.pairs
        verdict = np.empty(len(distinct), bool)
        for k, code in enumerate(distinct.tolist()):
            v = known.get(code)
            if v is None:
                a, b = code >> 20, code & 0xFFFFF
                v = known[code] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
            verdict[k] = v
        if len(known) > PAIRS:
            known.clear()
        good[inner] &= verdict[where]
        return good

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """word -> ids as little-endian 32-bit integers, for distinct words."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        first = np.zeros(len(flat), bool)
        first[start] = True
        passed = np.logical_and.reduceat(self.hold(flat, first), start)
        data, out = flat.astype("<u4").tobytes(), {}
        for w, r, ok, s, n in zip(words, raw, passed.tolist(), start.tolist(), lengths.tolist()):
            out[w] = data[4 * s:4 * (s + n)] if ok else np.array(self.merge(r), "<u4").tobytes()
        return out

    def pieces(self, text: str) -> list[str | int]:
        """Words, with special tokens as their ids."""
        if not self.at_special or not any(t in text for t in self.special):
            return self.split.findall(text)
        out: list = []
        for part in self.at_special.split(text):
            out += [self.special[part]] if part in self.special else self.split.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        if len(self.words) > WORDS:
            self.words.clear()
        known = self.words
        new = [w for w in {w for c in cut for w in c} - known.keys() if isinstance(w, str)]
        fresh = self.learn(new) if new else {}
        once = {w: ids for w, ids in fresh.items() if len(w) >= LONG}
        for w in once:
            del fresh[w]
        known.update(fresh)
        out = []
        for c in cut:
            try:
                out.append(b"".join([known[w] for w in c]))
            except KeyError:
                out.append(b"".join([w.to_bytes(4, "little") if isinstance(w, int)
                                     else known[w] if w in known else once[w] for w in c]))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(
            errors="replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at a path that every worker can open, read once a worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def round_trip(docs: DataFrame, path: str, chars: int = 2_000_000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned
    32-bit integers) and decoded, the text that the ids decode to.

    Null text counts as empty: no tokens, empty text.  Repeated rows and null
    ids are encoded like any other; extra columns are ignored; an empty table
    gives an empty result.  About `chars` characters are handled at a time.
    """
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part, texts in common.slices(batch, 1, chars):
                ids = v.encode_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()),
                     pa.array(ids, pa.binary()),
                     pa.array([v.decode(b) for b in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return common.small_batches(common.only(docs, doc_id="long", text="string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text."""
    return encoded.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256",
                              "sha2(cast(decoded AS BINARY), 256) AS decoded_sha256")
