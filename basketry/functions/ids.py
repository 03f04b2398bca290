"""Consecutive id allocation without a single-partition window over data.

Rows are range-partitioned on the ordering key, sorted inside each partition
and written once to the reliable checkpoint directory, which fixes the
partition layout (a lost executor re-reads the files instead of re-sampling
range bounds).  A per-partition count (one row per partition, so its size is
bounded by the partition count) gives each partition its offset;
``monotonically_increasing_id`` then encodes (partition, position) and the
final id is ``start + offset[partition] + position``.  The checkpoint is the
only job that building such a plan runs, whatever the size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir

_POSITION_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def _order_cols(order_by) -> list[Column]:
    cols = []
    for c in ([order_by] if isinstance(order_by, (str, Column)) else list(order_by)):
        cols.append(F.col(c).asc_nulls_last() if isinstance(c, str) else c)
    return cols


def consecutive_ids(df: DataFrame, order_by, id_col: str, start=1,
                    partitions: int | None = None) -> DataFrame:
    """Number the rows of ``df`` as ``start, start+1, ...`` in ``order_by`` order.

    ``order_by`` must be a total order over the rows for the ids to be
    deterministic.  ``start`` may be an int or a one-row DataFrame with a
    single column (e.g. a high-water mark + 1); it is never collected.
    """
    cols = _order_cols(order_by)
    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count AQE may coalesce neighbouring ranges, which
    # keeps them contiguous and in order; the checkpoint then fixes the layout.
    ranged = (df.repartitionByRange(partitions, *cols) if partitions
              else df.repartitionByRange(*cols)).sortWithinPartitions(*cols)
    fixed = ranged.checkpoint(eager=True)

    mid = F.monotonically_increasing_id()
    tagged = fixed.select("*", F.shiftright(mid, _POSITION_BITS).alias("_part"),
                          mid.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"))
    # The start value rides along as a pseudo-partition -1 that sorts before
    # every real one, so the running sum adds it to each offset (no cross join).
    if isinstance(start, DataFrame):
        first = start.select(F.lit(-1).cast("bigint").alias("_part"),
                             F.col(start.columns[0]).cast("bigint").alias("_n"))
    else:
        first = df.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("_part"),
                                                F.lit(int(start)).cast("bigint").alias("_n"))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).unionByName(first)
    # One row per partition (+1): bounded by the partition count, safe to broadcast.
    offsets = (counts.withColumn("_offset", F.coalesce(F.sum("_n").over(
                   Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .filter(F.col("_part") >= 0).select("_part", "_offset"))
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn(id_col, (F.col("_offset") + F.col("_pos")).cast("bigint"))
            .drop("_part", "_pos", "_offset"))


def dense_ids(df: DataFrame, value_col: str, id_col: str) -> DataFrame:
    """Distinct values of ``value_col`` with ids 1..n in ascending value order
    (nulls last), i.e. ``DENSE_RANK() OVER (ORDER BY value_col)``."""
    return consecutive_ids(df.select(value_col).distinct(), value_col, id_col, start=1)


#: Rows of one slice of `ids_by_rank`, about, and the most slices.
SLICE, SLICES = 200_000, 256


def ids_by_rank(df: DataFrame, order_col: str, id_col: str, after: DataFrame) -> DataFrame:
    """Number the rows of ``df`` in ascending order of the integer ``order_col``
    (distinct, not null), from one more than the single value of ``after``.

    Nothing is sorted or written as a whole: one aggregate finds quantiles of the
    order, rows are ranked inside the slices between them, and a slice starts
    behind the rows of the slices before it.  ``df`` is evaluated anew for the
    aggregate and for the result, so it must be a function of its inputs, as
    change sets read from files are; the numbers need no fixed partitions.
    """
    fractions = [i / SLICES for i in range(1, SLICES)]
    probe = df.agg(F.count(order_col).alias("n"), F.percentile_approx(order_col, fractions, 10_000).alias("at"))
    both = probe.unionByName(after.select(F.col(after.columns[0]).cast("bigint").alias("h")), allowMissingColumns=True)
    n, at, h = both.agg(F.max("n"), F.max("at"), F.max("h")).first()
    step = max(1, SLICES // max(2, -(-n // SLICE)))
    bounds = sorted(set((at or [0])[step - 1::step]))
    part = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b < F.col(order_col)))
    sliced = df.withColumn("_part", part)
    counts = sliced.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(  # at most a row a slice
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order_col))
    return (sliced.withColumn("_rank", rank).join(F.broadcast(offsets), "_part")
            .withColumn(id_col, (F.col("_offset") + F.col("_rank") + F.lit(h)).cast("bigint"))
            .drop("_part", "_rank", "_offset"))
