"""Scalar helpers and the distributed id numbering."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.functions.ids import consecutive_ids, dense_ids
from basketry.functions.numeric import pct_half_up
from basketry.functions.text import contains_pattern
from conftest import rows


def test_contains_pattern():
    assert contains_pattern("") == "%%"
    assert contains_pattern("a_b") == "%a_b%"
    assert contains_pattern("50\\") == "%50\\%"
    assert contains_pattern("\\q\\%\\\\") == "%q\\%\\\\%"


def test_pct_half_up_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (0, 0), (None, 5)], "a long, b long")
    got = [r[0] for r in df.select(pct_half_up("a", "b", 1)).collect()]
    assert got == [12.5, 33.3, 66.7, None, None]
    got = [r[0] for r in df.select(pct_half_up("a", "b", 0)).collect()]
    assert got == [13.0, 33.0, 67.0, None, None]


def test_consecutive_ids_match_a_global_row_number(spark):
    df = spark.range(0, 20000).select(((F.col("id") * 7919) % 20011).alias("k"))
    got = consecutive_ids(df, "k", "rid", start=5, partitions=7)
    ref = df.select("k", (F.row_number().over(Window.orderBy("k")) + 4).alias("expected"))
    assert got.count() == 20000
    assert got.join(ref, "k").filter(F.col("rid") != F.col("expected")).count() == 0
    start = spark.createDataFrame([(100,)], "s long")
    got = consecutive_ids(df, "k", "rid", start=start)
    assert rows(got.agg(F.min("rid"), F.max("rid"))) == [(100, 20099)]
    assert got.join(ref, "k").filter(F.col("rid") != F.col("expected") + 95).count() == 0


def test_dense_ids_nulls_last(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    assert sorted(rows(dense_ids(df, "v", "id")), key=lambda r: r[1]) == [
        ("a", 1), ("b", 2), (None, 3)]


def test_consecutive_ids_of_nothing(spark):
    empty = spark.createDataFrame([], "k long")
    assert consecutive_ids(empty, "k", "rid").count() == 0


def test_dense_ids_distributed_path(spark):
    df = spark.range(0, 3000).select((F.col("id") % 1000).cast("string").alias("v"))
    from basketry.functions.ids import consecutive_ids as cid
    got = cid(df.distinct(), "v", "id", start=1)
    ref = df.distinct().select("v", F.dense_rank().over(Window.orderBy("v")).alias("expected"))
    assert got.join(ref, "v").filter(F.col("id") != F.col("expected")).count() == 0


def test_order_sequence_with_a_hot_customer(spark):
    from basketry.sources.fixture import order_sequence
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    # one customer owns every third order (about a third of all rows)
    hot = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1))
                       .otherwise(F.col("o_custkey")))
    got = order_sequence(hot)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ref = hot.select("o_orderkey", F.row_number().over(w).alias("n"),
                     F.lag("o_orderdate").over(w).alias("p"))
    diff = got.join(ref, "o_orderkey").filter(
        (F.col("order_number") != F.col("n")) | ~F.col("prev_orderdate").eqNullSafe(F.col("p")))
    assert got.count() == hot.count() and diff.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the row-level window is per (customer, date), never per customer alone
    assert "hashpartitioning(o_custkey#" in plan and "o_orderdate" in plan


def test_recommended_conf_scales_with_input():
    from basketry.session import recommended_conf
    assert recommended_conf(4000, 100 * 10 ** 12)["spark.sql.shuffle.partitions"] == str(-(-100 * 10 ** 12 // (256 << 20)))
    assert recommended_conf(4000, 10 ** 12)["spark.sql.shuffle.partitions"] == "12000"
    assert recommended_conf(8, 10 ** 6)["spark.sql.shuffle.partitions"] == "24"


def test_checkpoint_dir_is_never_invented_on_a_cluster():
    import pytest as _pytest
    from basketry.session import ensure_checkpoint_dir

    class _Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class _Ctx:
        def __init__(self, master, configured):
            self.master, self._dir, self._conf = master, None, _Conf(configured)

        def getCheckpointDir(self):
            return self._dir

        def getConf(self):
            return self._conf

        def setCheckpointDir(self, path):
            self._dir = path

    class _Spark:
        def __init__(self, master, configured=None):
            self.sparkContext = _Ctx(master, configured or {})
            self.conf = _Conf(configured or {})

    with _pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark("yarn"))
    shared = "hdfs://nn/shared/ckpt"
    assert ensure_checkpoint_dir(_Spark("yarn", {"spark.checkpoint.dir": shared})) == shared
