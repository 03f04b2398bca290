"""The corpus pipeline: its stages on odd rows, and the whole against brute force."""
import hashlib
import zlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from basketry.llm import common, langid, mixing, queries, toxicity
from helpers import SF
from test_jaccard import brute


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [n for n, _ in pipeline.STAGES] == [
        "toxicity", "language", "near_duplicates", "mixing", "bpe"]
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


def test_whole_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    model = toxicity.fit(docs, queries.table(spark, SF, "labels"), common.fold(F.col("doc_id"), 5) != 0)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    left = docs.filter(F.col("doc_id").isin([i for i, s in score.items() if s < 0.5]))
    lang = langid.predict(left, langid.fit(left, langid.usable_fold(F.col("doc_id"))))
    fine = [r["doc_id"] for r in lang.collect() if r["lang_pred"] != "und" and r["score"] >= 0.4]
    left = left.filter(F.col("doc_id").isin(fine))
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    groups = brute(rows)
    left = left.filter(F.col("doc_id").isin([i for i, (_, c) in groups.items() if i == c]))
    copies = [(r["doc_id"], r["text"]) for r in mixing.mix(left).collect()]
    lib = Tokenizer.from_file(queries.TOKENIZER)
    want = []
    for i, t in copies:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in pipeline.run(spark, SF).collect()) == sorted(want)


def test_stages_on_odd_rows(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame(
        [(None, "some words of a text without an id", None, None, None), (90_001, None, "en", "x", 0),
         (90_002, "", None, None, 0), (90_003, "the and of the that " * 30_000, "en", "src0", 1),
         (90_003, "the and of the that " * 30_000, "en", "src0", 1)], docs.schema)
    docs = docs.union(odd).withColumn("Score", F.lit(1)).withColumn("copy", F.array(F.lit("a")))
    for name, stage in pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, SF), "test-" + name)
        assert out.dtypes == docs.dtypes, name
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0
        if name == "toxicity":
            assert 0 <= docs.count() - out.count() < 40
        if name == "language":
            ids = [r["doc_id"] for r in out.select("doc_id").collect()]
            assert 90_001 not in ids and 90_002 not in ids and len(ids) > 150
        if name == "near_duplicates":
            assert [r["doc_id"] for r in out.collect()].count(90_003) == 1
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_read_the_column_of_their_name():
    from types import SimpleNamespace

    assert common.position(SimpleNamespace(columns=["TEXT", "doc_id", "text"]), "text") == 2
    assert common.position(SimpleNamespace(columns=["doc_id", "Text"]), "text") == 1


def test_language_stage_without_languages(spark):
    """No row has a label, or only held-out rows have one: clean documents stay."""
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2][:2]
    for lang in (dict.fromkeys(held), dict.fromkeys(held, "en")):
        rows = [(i, "a clean text", lang.get(i)) for i in (*held, 100)] + [(101, "12 !", None), (102, None, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        kept = pipeline.drop_unknown_language(spark, docs, SF).collect()
        assert sorted(r["doc_id"] for r in kept) == [*held, 100]
