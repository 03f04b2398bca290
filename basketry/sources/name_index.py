"""Trigram index of product names, kept with a snapshot.

A posting says that a product's name, in lower case, holds three characters in a
row; postings are sorted by the three, so a filter on a few of them reads the row
groups that hold them.  A search takes the literal runs of its LIKE pattern,
looks up their rarest trigrams, and only products with all of these are matched
against the pattern, which stays the judge: postings of names that have since
gone or changed cost a comparison, not a wrong row.  So a change set only adds
the postings of its new rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trigrams of a pattern that are intersected: its rarest.  More narrow the
#: candidates further, and read more postings.
RAREST = 4


def grams(products: DataFrame) -> DataFrame:
    """(gram, product_id), each once a product."""
    name = F.lower("product_name")
    each = F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substr(name, i, F.lit(3)))
    return products.filter(F.length(name) >= 3).select(F.explode(F.array_distinct(each)).alias("gram"), "product_id")


def write(products: DataFrame, path: str) -> None:
    """The postings of ``products`` and how many each trigram has, below ``path``."""
    (grams(products).repartitionByRange("gram", "product_id").sortWithinPartitions("gram", "product_id")
     .write.mode("errorifexists").parquet(f"{path}/postings"))
    written = products.sparkSession.read.parquet(f"{path}/postings")
    (written.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram")
     .write.mode("errorifexists").parquet(f"{path}/counts"))


def literal_runs(pattern: str) -> list[str]:
    """The runs of a LIKE pattern (escape character ``\\``) that stand for themselves."""
    runs, at = [""], 0
    while at < len(pattern):
        if pattern[at] in "%_":
            runs.append("")
        else:
            at += pattern[at] == "\\" and at + 1 < len(pattern)
            runs[-1] += pattern[at]
        at += 1
    return [r for r in runs if r]


@dataclass(frozen=True)
class NameIndex:
    postings: DataFrame  # gram, product_id
    counts: DataFrame    # gram, n; a row a layer

    @classmethod
    def read(cls, spark: SparkSession, paths: list[str]) -> NameIndex:
        parts = [[spark.read.parquet(f"{p}/{kind}") for p in paths] for kind in ("postings", "counts")]
        return cls(*(reduce(DataFrame.unionByName, p) for p in parts))

    def candidates(self, pattern: str) -> DataFrame | None:
        """(product_id), each once: products whose name can match the ILIKE
        ``pattern``; None if any can, as no run of it has three characters."""
        spark = self.postings.sparkSession
        lowered = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]  # as the names were
        wanted = sorted({r[i:i + 3] for r in literal_runs(lowered) for i in range(len(r) - 2)})
        if not wanted:
            return None
        found = {r[0]: r[1] for r in self.counts.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(
            F.sum("n")).collect()}  # a row a trigram of the pattern
        rarest = sorted(wanted, key=lambda g: (found.get(g, 0), g))[:RAREST]
        hits = self.postings.filter(F.col("gram").isin(rarest)).groupBy("product_id").agg(
            F.count_distinct("gram").alias("n"))  # layers may repeat a posting
        return hits.filter(F.col("n") == len(rarest)).select("product_id")
