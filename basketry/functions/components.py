"""Connected components of an edge list, by alternating large and small stars.

Each round links every node's larger neighbours to the smallest node around it
and then the smaller ones, until the graph is a set of stars.  Rounds are one
aggregate (combined before the shuffle) and one join each, so a node with a
third of all edges is pre-aggregated and its join is split by AQE; every round
ends in a written table.  Only a count and a checksum reach the driver.  The tasks after a shuffle are as many as the counted edges
ask for, so a small round on a large cluster is not a thousand empty tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import drop_scratch, release, scratch_path


#: Edges a task, and tasks at least.
EDGES, TASKS = 100_000, 8


def _cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Written to the shared checkpoint directory and read back; the folder."""
    path = scratch_path(df.sparkSession, "stars")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> node, component (its smallest node), for nodes with an edge to
    another; loops, repeated and null edges do no harm."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, path = _cut(e.distinct())
    state = _state(e)
    while state[0]:
        few = max(TASKS, state[0] // EDGES)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        low = low.select("x", F.least("x", "m").alias("m")).coalesce(few)
        large = (both.join(low, F.col("u") == F.col("x")).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct().coalesce(few))
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).coalesce(few)
        small = large.join(low, F.col("u") == F.col("x")).filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few)
        last = path
        e, path = _cut(small.union(low.select("x", "m")).distinct().coalesce(few))
        del both, low, large, small
        drop_scratch(edges.sparkSession, last)
        release(edges.sparkSession)
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
