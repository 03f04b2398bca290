"""Rank-file BPE against the library on whole texts, and long texts against one
match at a time."""
import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import queries, rank_bpe
from helpers import SF, docs

public_tokenizers = pytest.importorskip("public_tokenizers")
regex = pytest.importorskip("regex")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "don't stop", "a<|endoftext|>b  \n\n c", "é" * 80, "x" * 700, "12ab３ ½   z ",
         " " * 90 + "a", "日本語 текст عربى 👩‍👧    x", "\r\n\t\x0b\x00\x1c\x1d", "'S 's 'LL 'll", "﻿a b　c",
         "word " * 3000, "aaaaaaaaaaaaaaaaaaaaaaab" * 40]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def as_ids(raw):
    return [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def one_match_at_a_time(library, text):
    return [i for m in regex.findall(public_tokenizers.PATTERN, text)
            for i in library._core_bpe.encode_single_piece(m.encode())]


def test_the_pattern_is_the_files_pattern():
    assert rank_bpe.PATTERN == public_tokenizers.PATTERN


def test_edge_texts(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "b c")]
    d = docs(spark, rows).withColumn("ids", F.lit("mine")).withColumn("DECODED", F.lit(1))
    got = [tuple(r) for r in rank_bpe.digests(rank_bpe.round_trip(d, PATH)).collect()]
    assert sorted(got, key=str) == sorted(((i, *expected(library, t)) for i, t in rows), key=str)
    assert rank_bpe.round_trip(d.limit(0), PATH).count() == 0


def test_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    got = queries.QUERIES["op12_rank_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == expected(library, texts[r["doc_id"]])


@pytest.mark.parametrize("text", [
    " " * 1_000_000 + "a", "a" + "\n \t" * 300_000, "x" * 150_000 + "7" * 60_000, "é" * 120_000,
    ("ab 12 'll" + " " * 2_500 + "\n") * 40, "." * 100_000 + "'s" * 50_000, "日" * 70_000 + "本、" * 30_000,
    (" " * 1_999 + "q" + " " * 2_000 + "'d") * 20], ids=range(8))
def test_very_long_texts(library, text):
    r = rank_bpe.ranks(PATH)
    parts = list(rank_bpe.stretches(text))
    assert "".join(p for p, _ in parts) == text
    ids = r.encode(text)
    assert as_ids(ids) == one_match_at_a_time(library, text)
    assert r.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sdl7a.é　́½")),
                                  st.characters(exclude_categories=("Cs",))), max_size=60), st.integers(1, 9))
def test_any_text_in_stretches_of_any_size(text, size):
    r = rank_bpe.ranks(PATH)
    ids = [i for part, _ in rank_bpe.stretches(text, size) for i in r.library.encode_ordinary(part)]
    assert ids == r.library.encode_ordinary(text)
    assert r.decode(r.encode(text)) == text.encode()
