"""Shared pre-aggregations of the order-line fact table.

Catalyst does not push an aggregation below a join, so the dashboard plans
aggregate ``order_details`` per product first (partial aggregation on the
map side, then one shuffle of at most #products rows per task) and only then
join the product dimension.  A product or department holding a large share
of all lines costs nothing extra: it is one partial-aggregate row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.tables import Tables

# Products at or below this many rows (a proven count, from the snapshot's
# publication record) are broadcast into the line scan as two longs per row,
# names never: 32 MB of values at most.
BROADCAST_MAX_PRODUCTS = 2_000_000


def _product_map(t: Tables) -> DataFrame | None:
    """(product_id, department_id) as a broadcast side, if its size is proven."""
    n = t.known_rows("products")
    if n is not None and n <= BROADCAST_MAX_PRODUCTS:
        return F.broadcast(t.products.select("product_id", "department_id"))
    return None


def department_name_line_totals(t: Tables) -> DataFrame:
    """(department, items, lines, reorders) grouped by department NAME: the
    totals per id first, then the names of those few rows."""
    named = (department_line_totals(t).join(t.departments, "department_id")
             .select("department", F.col("items").alias("_i"), F.col("lines").alias("_l"),
                     F.col("reorders").alias("_r")))
    return (named.groupBy("department")
            .agg(F.sum("_i").alias("items"), F.sum("_l").alias("lines"),
                 F.sum("_r").alias("reorders")))


def product_line_totals(t: Tables) -> DataFrame:
    """(product_id, items, lines, reorders) over all order lines.

    items = COUNT(product_id), lines = COUNT(*), reorders = SUM(reordered).
    """
    return (t.order_details.groupBy("product_id")
            .agg(F.count("product_id").alias("items"),
                 F.count(F.lit(1)).alias("lines"),
                 F.sum("reordered").alias("reorders")))


def department_line_totals(t: Tables) -> DataFrame:
    """(department_id, items, lines, reorders): lines joined to their product.

    With a proven-small product table the map is broadcast into the line
    scan and lines aggregate straight to departments; otherwise lines are
    aggregated per product first and the (large) product table is joined to
    that much smaller result.
    """
    small = _product_map(t)
    if small is not None:
        return (t.order_details.select("product_id", "reordered").join(small, "product_id")
                .groupBy("department_id")
                .agg(F.count("product_id").alias("items"), F.count(F.lit(1)).alias("lines"),
                     F.sum("reordered").alias("reorders")))
    return (product_line_totals(t)
            .join(t.products.select("product_id", "department_id"), "product_id")
            .groupBy("department_id")
            .agg(F.sum("items").alias("items"), F.sum("lines").alias("lines"),
                 F.sum("reorders").alias("reorders")))


def department_hour_totals(t: Tables) -> DataFrame:
    """(department_id, hour, items, reorders, lines) in one pass over the lines.

    Lines shrink before they meet the orders: with a proven-small product
    table they are mapped to departments and partially aggregated to one row
    per (order, department) and task, otherwise to one per (order, product).
    The order join is a LEFT join so that ``items``/``reorders`` cover every
    line (the department statistics) while ``lines`` counts only lines whose
    order exists (the hour ranking joins orders with an inner join).
    """
    small = _product_map(t)
    if small is not None:
        per_order = t.order_details.join(small, "product_id").groupBy("order_id", "department_id")
    else:
        per_order = t.order_details.groupBy("order_id", "product_id")
    per_order = per_order.agg(F.count("product_id").alias("_i"), F.count(F.lit(1)).alias("_l"),
                              F.sum("reordered").alias("_r"))
    orders = t.orders.select("order_id", F.col("order_hour_of_day").alias("hour"),
                             F.lit(1).alias("_matched"))
    joined = per_order.join(orders, "order_id", "left")
    sums = [F.sum("_i").alias("items"), F.sum("_r").alias("reorders"),
            F.coalesce(F.sum(F.when(F.col("_matched").isNotNull(), F.col("_l"))), F.lit(0))
            .alias("lines")]
    if small is not None:
        return joined.groupBy("department_id", "hour").agg(*sums)
    per_product = joined.groupBy("product_id", "hour").agg(*sums)
    return (per_product
            .join(t.products.select("product_id", "department_id"), "product_id")
            .groupBy("department_id", "hour")
            .agg(F.sum("items").alias("items"), F.sum("reorders").alias("reorders"),
                 F.sum("lines").alias("lines")))
