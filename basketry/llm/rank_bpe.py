"""Byte-level BPE by a rank file with the tiktoken library, and raw-byte decoding.

The library splits a text by the pattern and merges each match by the ranks.
Its pattern engine is handed short stretches only: a long text is cut where the
pattern ends a match whatever follows, which is after a letter before anything
but a letter, after a digit before anything but a digit, and after anything
that is not white space before white space.  No match holds such a place
inside, and no match looks across one but for white space, so the stretches
give the tokens of the whole text.  A very long run of white space, on which
the engine runs out of stack, is one match by itself: all of it at the end of
the text, else all but its last character, which belongs to what follows.

Ids decode to the bytes their tokens stand for, joined.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common

# ---- fixed values: the splitting pattern of the rank files ---------------------
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ---- end of fixed values -------------------------------------------------------

#: Characters of a text handed to the library at once, and the white space in a
#: row from which on a run is a stretch of its own.
STRETCH, RUN = 50_000, 2_000

_boundary = regex.compile(r"\S(?=\s)|\p{L}(?=\P{L})|\p{N}(?=\P{N})")
_long_run = regex.compile(r"\s{%d,}" % RUN)


def stretches(text: str, size: int = STRETCH):
    """(part of the text, whether it is one match of the pattern), in order."""
    at = 0
    while at < len(text):
        run = _long_run.search(text, at) if len(text) - at >= RUN else None
        end = run.start() if run else len(text)
        while at < end:
            found = _boundary.search(text, at + size - 1, end) if end - at > size else None
            cut = found.end() if found else end
            yield text[at:cut], False
            at = cut
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start():at], True


class Ranks:
    """A rank file's encoder and decoder."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = self.library._core_bpe.encode_single_piece
        self.bytes = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ordinary, single = self.library.encode_ordinary, self.single
        if len(text) < RUN:
            return np.array(ordinary(text), "<u4").tobytes()
        return b"".join(np.array(single(part.encode()) if whole else ordinary(part), "<u4").tobytes()
                        for part, whole in stretches(text))

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    """The rank file at a path that every worker can open, read once a worker."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def round_trip(docs: DataFrame, path: str, chars: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned
    32-bit integers) and decoded, the bytes that the ids stand for.

    Null text counts as empty: no tokens, no bytes.  Repeated rows and null ids
    are encoded like any other, there is nothing that could tie; extra columns
    are ignored, also such as are named like a result; an empty table gives an
    empty result.  Texts of any length are encoded whole; about `chars`
    characters, at least one text, are held at a time.
    """
    def run(batches):
        r = ranks(path)
        for batch in batches:
            for part, texts in common.slices(batch, 1, chars):
                ids = [r.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array([r.decode(b) for b in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return common.small_batches(common.only(docs, doc_id="long", text="string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
