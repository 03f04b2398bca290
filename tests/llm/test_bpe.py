"""BPE against the tokenizers library, texts of every kind, and the round trip."""
import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import bpe, queries
from helpers import SF, docs

pytestmark = pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no vocabulary files")
TEXTS = [None, "", " ", "a", "don't stop", "a<|endoftext|>b  \n\n c<|endoftext|>", "<|endoftext|", "é" * 80,
         "x" * 700, "12ab３ ½   z ", " " * 90 + "a", "日本語 текст عربى 👩‍👧    x", "\r\n\t\x0b\x00",
         "'S 's 'LL 'll", "word " * 3000, "aaaaaaaaaaaaaaaaaaaaaaab" * 40]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_edge_texts(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "b c")]
    d = docs(spark, rows).withColumn("ids", F.lit("mine"))
    got = [tuple(r) for r in bpe.digests(bpe.round_trip(d, queries.TOKENIZER)).collect()]
    assert sorted(got, key=str) == sorted(((i, *expected(library, t)) for i, t in rows), key=str)
    assert bpe.round_trip(d.limit(0), queries.TOKENIZER).count() == 0


def test_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    for r in queries.QUERIES["op6_bpe_round_trip"](spark, SF).collect():
        assert tuple(r)[1:] == expected(library, texts[r["doc_id"]])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(text):
    v = bpe.vocabulary(queries.TOKENIZER)
    lib = test_any_text.__dict__.setdefault("lib", Tokenizer.from_file(queries.TOKENIZER))
    ids = v.encode_batch([text])[0]
    assert [int.from_bytes(ids[i:i + 4], "little") for i in range(0, len(ids), 4)] == \
        lib.encode(text, add_special_tokens=False).ids
    assert v.decode(ids) == text


def test_both_merges_agree():
    v = bpe.vocabulary(queries.TOKENIZER)
    for word in (b" thereafter", b"aaaaabaaa", "überraschung".encode(), b"xqzjk" * 12):
        long = word * (1 + bpe.LONG // len(word))
        assert v.merge(long) == v.merge_short([v.single[b] for b in long])
