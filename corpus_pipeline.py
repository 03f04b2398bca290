"""From raw documents to a mixed, encoded training corpus.

Toxic documents and documents of no known language go, one document of each
group of near duplicates stays, sources are mixed to target weights, and the
result is encoded.  Each stage takes (spark, docs, sf_dir); its result is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, common, jaccard, langid, mixing, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score 0.5 or more go.

    Null, empty and very long texts are scored like any other, whole; repeated
    rows get the same score; rows with a null id are scored and not learned
    from; without labels or documents nothing goes."""
    usable = F.coalesce(common.fold(F.col("doc_id"), 5) != 0, F.lit(False))
    return toxicity.keep(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), usable))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that are undetermined or score below 0.4 go; with
    no language to learn from, those without a letter.

    So null and empty texts go; texts of any length are judged whole; equal
    scores go to the first language by name; repeated rows are judged one by
    one; an empty table stays empty."""
    return langid.keep(docs, langid.fit(docs, langid.usable_fold(F.col("doc_id"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each component the document of the smallest id stays.

    Documents without a word and rows with a null id all stay; rows that repeat
    an id and its text are one document; texts are compared whole; an empty
    table stays empty."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sources weigh the square root of their characters.

    A null source is a source; null texts count no character; rows with a null
    id share one draw, as do rows that repeat an id; texts are carried whole; an
    empty table stays empty."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token count and digests of every copy.

    Null texts count as empty; texts of any length are encoded whole, repeated
    rows one by one; only the operator's columns are returned; an empty table
    gives an empty result."""
    return bpe.digests(bpe.round_trip(docs, queries.TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language),
          ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Learned models and the tokenizer are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
