"""Dashboard reads: store metrics, hour / weekday profiles, department rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.labels import dow_label
from basketry.functions.numeric import pct_half_up, round_half_up
from basketry.plans.facts import department_name_line_totals
from basketry.tables import Tables


def kpis(t: Tables) -> DataFrame:
    """total_orders, total_products, reorder_pct (1 dp), avg_days_between (1 dp).

    Three independent one-row aggregates, combined by a union and a final
    aggregate over three rows (no cross join).  ``orders`` is scanned once.
    On audited tables ``order_id`` is a proven key, so COUNT(DISTINCT) is a
    plain count and the whole metric is map-side partial aggregates; otherwise
    a per-order aggregate (one shuffle by order id) gives the exact distinct
    count and the sums for the average together.
    """
    days = "days_since_prior_order"
    if t.audited:
        o = t.orders.agg(F.count("order_id").alias("total_orders"),
                         F.sum(days).alias("_days"), F.count(days).alias("_n_days"))
    else:
        per_order = (t.orders.groupBy("order_id")
                     .agg(F.sum(days).alias("_s"), F.count(days).alias("_c")))
        o = per_order.agg(F.count("order_id").alias("total_orders"),
                          F.sum("_s").alias("_days"), F.sum("_c").alias("_n_days"))
    p = t.products.agg(F.count(F.lit(1)).alias("total_products"))
    d = t.order_details.agg(F.sum("reordered").alias("_reorders"),
                            F.count(F.lit(1)).alias("_lines"))
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [o, p, d])
    m = one.agg(*[F.max(c).alias(c) for c in
                  ["total_orders", "total_products", "_days", "_n_days", "_reorders", "_lines"]])
    return m.select(
        F.col("total_orders").cast("bigint").alias("total_orders"),
        F.col("total_products").cast("bigint").alias("total_products"),
        pct_half_up("_reorders", "_lines", 1).alias("reorder_pct"),
        round_half_up(F.when(F.col("_n_days") > 0, F.col("_days") / F.col("_n_days")), 1)
        .alias("avg_days_between"))


def orders_by_hour(t: Tables) -> DataFrame:
    """R2: (hour, orders), ascending hour; hours without orders are absent."""
    return (t.orders.groupBy(F.col("order_hour_of_day").alias("hour"))
            .agg(F.count(F.lit(1)).alias("orders"))
            .orderBy(F.col("hour").asc_nulls_last()))


def orders_by_dow(t: Tables) -> DataFrame:
    """(dow, label, orders), ascending weekday code."""
    return (t.orders.groupBy(F.col("order_dow").alias("dow"))
            .agg(F.count(F.lit(1)).alias("orders"))
            .select("dow", dow_label("dow").alias("label"), "orders")
            .orderBy(F.col("dow").asc_nulls_last()))


def _by_department_name(t: Tables) -> DataFrame:
    return department_name_line_totals(t)


def top_departments(t: Tables, n: int = 10) -> DataFrame:
    """The n departments with most order lines (ties by name)."""
    return (_by_department_name(t).select("department", "items")
            .orderBy(F.col("items").desc_nulls_first(), F.col("department").asc_nulls_last())
            .limit(n))


def reorder_rate_by_department(t: Tables, n: int = 10) -> DataFrame:
    """The n departments with the highest reorder share, sorted on the
    rounded percentage (as the reference does), ties by name."""
    return (_by_department_name(t)
            .select("department", pct_half_up("reorders", "lines", 1).alias("reorder_pct"))
            .orderBy(F.col("reorder_pct").desc_nulls_first(), F.col("department").asc_nulls_last())
            .limit(n))
