"""Basket tables derived from the generated TPC-H-style inputs (FIXTURES.md).

The reference ships no data, so the six tables are mapped from ``part``,
``orders`` and ``lineitem``:

* department = ``p_brand``, aisle = ``p_type``; ids are the dense rank of the
  name (distributed numbering, `basketry.functions.ids`);
* an order's weekday is the weekday of ``o_orderdate`` (Sunday = 0), its hour
  ``(o_orderkey * 7 + o_custkey) % 24``; order number and day gap come from
  the customer's order sequence by (``o_orderdate``, ``o_orderkey``); first
  orders have no gap and are dropped, as the reference's ``dropna`` does;
* an order line is one (order, part) pair of ``lineitem``: its lowest line
  number is the cart position, ``reordered`` = any line with return flag R.

All of it is lazy DataFrame work except three derived tables that many queries
share, the two id maps and the orders with their sequence: they are written
once per session and input, under the checkpoint directory, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.ids import dense_ids
from basketry.session import scratch_path, session_key
from basketry.tables import Tables

#: Bytes of the order lines' files that one task takes after they are dealt by order, about.
LINE_BYTES = 4 << 20

_DERIVED: dict = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(spark: SparkSession, path: str) -> tuple:
    """(name, size, modification time) of the files of an input, on any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime())
                        for s in fs.listStatus(p)))


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """departments, aisles and all orders of ``sf_dir``, written once while the
    session lasts and the inputs stay the same."""
    key = (session_key(spark), sf_dir, *(_stamp(spark, f"{sf_dir}/{t}.parquet")
                                         for t in ("part", "orders")))
    if key not in _DERIVED:
        part = _read(spark, sf_dir, "part")
        frames = {
            "departments": dense_ids(part, "p_brand", "department_id")
            .select("department_id", F.col("p_brand").alias("department")),
            "aisles": dense_ids(part, "p_type", "aisle_id")
            .select("aisle_id", F.col("p_type").alias("aisle")),
            "orders": _all_orders(spark, sf_dir)}
        found = {}
        for name, df in frames.items():
            path = scratch_path(spark, f"fixture-{name}")
            df.write.parquet(path)
            found[name] = spark.read.parquet(path)
        _DERIVED[key] = found
    return _DERIVED[key]


def forget() -> None:
    """Derive again at the next use (for timing)."""
    _DERIVED.clear()


def _products(spark, sf_dir, departments, aisles) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return (part
            .join(departments, part.p_brand.eqNullSafe(departments.department))
            .join(aisles, part.p_type.eqNullSafe(aisles.aisle))
            .select(F.col("p_partkey").alias("product_id"),
                    F.col("p_name").alias("product_name"), "aisle_id", "department_id"))


def order_sequence(orders: DataFrame) -> DataFrame:
    """Every order with its per-customer number and previous order date.

    Equivalent to ``row_number`` / ``lag`` over ``PARTITION BY o_custkey ORDER
    BY o_orderdate, o_orderkey`` but in two levels, so one customer holding a
    large share of all orders is not a single window group: the row-level
    window is per (customer, order date), and the per-customer window runs
    over one row per distinct order date of that customer.
    """
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    per_day = (o.groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("_n")))
    by_cust = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").asc_nulls_last())
    per_day = per_day.select(
        F.col("o_custkey").alias("_c"), F.col("o_orderdate").alias("_d"),
        F.coalesce(F.sum("_n").over(by_cust.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.lag("o_orderdate").over(by_cust).alias("_prev_day"))
    within_day = Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")
    rows = o.withColumn("_rn", F.row_number().over(within_day))
    joined = rows.join(per_day, rows.o_custkey.eqNullSafe(per_day._c)
                       & rows.o_orderdate.eqNullSafe(per_day._d))
    return joined.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
        (F.col("_before") + F.col("_rn")).alias("order_number"),
        F.when(F.col("_rn") > 1, F.col("o_orderdate")).otherwise(F.col("_prev_day"))
        .alias("prev_orderdate"))


def _all_orders(spark, sf_dir) -> DataFrame:
    seq = order_sequence(_read(spark, sf_dir, "orders"))
    return seq.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.lit("train").alias("eval_set"),
        F.col("order_number").cast("bigint").alias("order_number"),
        (F.dayofweek("o_orderdate") - 1).cast("bigint").alias("order_dow"),
        ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 24).cast("bigint")
        .alias("order_hour_of_day"),
        F.datediff(F.to_date("o_orderdate"), F.to_date("prev_orderdate")).cast("double")
        .alias("days_since_prior_order"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(1).alias("times"))


def _by_order(spark, sf_dir, lines: DataFrame) -> DataFrame:
    """``lines`` dealt by order: grouping and joining them by order needs no
    further shuffle, and a task gets about `LINE_BYTES` of the input whatever
    its size, so its memory does not grow with it."""
    parts = -(-sum(size for _, size, _ in _stamp(spark, f"{sf_dir}/lineitem.parquet")) // LINE_BYTES)
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return lines.repartition("order_id")  # adaptive execution may merge partitions
    return lines.repartition(parts, "order_id")


def _lines(spark, sf_dir) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), "l_linenumber",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("_r"))
    return (_by_order(spark, sf_dir, li).groupBy("order_id", "product_id")
            .agg(F.min("l_linenumber").cast("bigint").alias("add_to_cart_order"),
                 F.max("_r").cast("bigint").alias("reordered")))


def _kept_orders(spark, sf_dir) -> DataFrame:
    return (derived(spark, sf_dir)["orders"].filter(F.col("days_since_prior_order").isNotNull())
            .drop("times"))


def _dependants(spark, sf_dir, orders: DataFrame) -> dict:
    return {"users": orders.select("user_id").distinct(),
            "order_details": _lines(spark, sf_dir).join(orders.select("order_id"), "order_id",
                                                        "left_semi")}


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The six basket tables mapped from ``sf_dir`` (lazy, except `derived`)."""
    departments, aisles = (derived(spark, sf_dir)[t] for t in ("departments", "aisles"))
    orders = _kept_orders(spark, sf_dir)
    return Tables(
        departments=departments,
        aisles=aisles,
        products=_products(spark, sf_dir, departments, aisles),
        orders=orders,
        **_dependants(spark, sf_dir, orders),
    ).conform()


def publish_fixture(spark: SparkSession, sf_dir: str, root: str,
                    order_buckets_n: int | None = None) -> str:
    """Map ``sf_dir`` to the six tables and publish them as an audited snapshot.

    The per-customer order sequence is derived and written once; ``users``
    and ``order_details`` are then derived from the written orders instead of
    recomputing the sequence for each of them.
    """
    from basketry.sources import snapshot

    version = snapshot.new_version(root)
    buckets = snapshot.order_buckets(order_buckets_n)
    tables = fixture_tables(spark, sf_dir)
    first = {"departments": tables.departments, "aisles": tables.aisles,
             "products": tables.products, "orders": tables.orders}
    snapshot.write_frames(first, version, buckets)
    written_orders = spark.read.parquet(f"{version}/orders")
    rest = Tables(**{**first, "orders": written_orders,
                     **_dependants(spark, sf_dir, written_orders)}).conform()
    snapshot.write_frames({"users": rest.users, "order_details": rest.order_details}, version,
                          buckets)
    snapshot.publish(spark, version, buckets)
    return version


def fixture_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denormalised one-row-per-line frame a CSV export would hold.

    It keeps first orders (NULL day gap) and repeats the lines of urgent
    orders (``o_orderpriority = '1-URGENT'``), so cleaning has duplicates and
    incomplete rows to remove.
    """
    d = derived(spark, sf_dir)
    products = (_products(spark, sf_dir, d["departments"], d["aisles"])
                .join(d["departments"], "department_id").join(d["aisles"], "aisle_id"))
    # a task hashes its products and lets the lines pass; for a merge join it would
    # sort its lines, whose memory, and spill, grow with the input
    wide = _lines(spark, sf_dir).join(d["orders"], "order_id").join(products.hint("shuffle_hash"), "product_id")
    cols = ["order_id", "product_id", "add_to_cart_order", "reordered", "user_id", "eval_set",
            "order_number", "order_dow", "order_hour_of_day", "days_since_prior_order",
            "product_name", "aisle_id", "department_id", "aisle", "department"]
    return wide.select(*cols, F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select(*cols)
