"""Maintained aggregates: small cells that the hour, weekday and department
reports are sums of, carried from snapshot to snapshot.

``department_hour`` holds items, reorders and placed lines per department and
hour, ``hour_dow`` the orders per hour and weekday: a few hundred rows, whatever
the tables hold.  After a change set the cells get what the touched lines and
orders were worth before, negative, and what they are worth after; everything
else is left unread but for the keys that tell touched lines from others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.labels import dow_label
from basketry.functions.numeric import pct_half_up
from basketry.operators.changes import Step
from basketry.plans.departments import peak_hours
from basketry.plans.facts import department_hour_totals
from basketry.schema import PRIMARY_KEYS
from basketry.tables import Tables


@dataclass(frozen=True)
class Cells:
    department_hour: DataFrame  # department_id, hour, items, reorders, lines
    hour_dow: DataFrame         # hour, dow, orders

    def items(self):
        return [("department_hour", self.department_hour), ("hour_dow", self.hour_dow)]


KEYS = {"department_hour": ["department_id", "hour"], "hour_dow": ["hour", "dow"]}
SCHEMAS = {"department_hour": "department_id bigint, hour bigint, items bigint, reorders bigint, lines bigint",
           "hour_dow": "hour bigint, dow bigint, orders bigint"}


def _hour_dow(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("order_hour_of_day").alias("hour"), F.col("order_dow").alias("dow")).agg(
        F.count(F.lit(1)).alias("orders"))


def cells_of(t: Tables) -> Cells:
    """The cells of the tables, from all their rows."""
    return Cells(department_hour_totals(t).select("department_id", "hour", "items", "reorders", "lines"),
                 _hour_dow(t.orders))


def _differing(before: Tables, after: Tables, steps: list[Step], table: str, values: list[str]) -> DataFrame | None:
    """Keys of a touched table whose row came, went, or differs in ``values``;
    None if no step touches it."""
    if table not in {s.table for s in steps}:
        return None
    key = PRIMARY_KEYS[table][0]
    sides = []
    for t, sign in ((before, -1), (after, 1)):
        sides.append(getattr(t, table).select(key, *values).withColumn("_side", F.lit(sign)))
    keys = _keys(before, steps, table)
    both = reduce(DataFrame.unionByName, sides).join(keys, key, "left_semi")
    # the same row on both sides adds up to nothing
    return both.groupBy(key, *values).agg(F.sum("_side").alias("_n")).filter("_n <> 0").select(key).distinct()


def _keys(before: Tables, steps: list[Step], table: str) -> DataFrame:
    """The one-column keys of a table that its steps name."""
    key, parts = PRIMARY_KEYS[table][0], []
    for s in (s for s in steps if s.table == table):
        removed = s.removed()
        if removed is not None:
            parts.append(removed if removed.columns == [key] else
                         getattr(before, table).join(removed, removed.columns, "left_semi").select(key))
        if s.rows is not None:
            parts.append(s.added().select(key))
    return reduce(DataFrame.unionByName, parts).distinct()


def _touched_lines(t: Tables, keys: list[DataFrame]) -> DataFrame:
    """The order lines with a key of one of the frames (by its columns), each once."""
    lines, marks = t.order_details, []
    for i, k in enumerate(keys):
        lines = lines.join(k.distinct().withColumn(f"_k{i}", F.lit(1)), k.columns, "left")
        marks.append(F.col(f"_k{i}").isNotNull())
    touched = reduce(lambda a, b: a | b, marks) if marks else F.lit(False)
    return lines.filter(touched).select(*t.order_details.columns)


def _summed(name: str, parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """The sum of signed cells; cells that hold nothing go."""
    keys = KEYS[name]
    values = [c for c in parts[0][1].columns if c not in keys]
    signed = [df.select(*keys, *[(F.lit(sign) * F.coalesce(c, F.lit(0))).alias(c) for c in values]) for sign, df in parts]
    out = reduce(DataFrame.unionByName, signed).groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in values])
    return out.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in values]))


def after_change(cells: Cells, before: Tables, after: Tables, steps: list[Step]) -> Cells:
    """The cells of ``after``, which is ``before`` with ``steps`` taken, from
    those of ``before``."""
    products = _differing(before, after, steps, "products", ["department_id"])
    orders = _differing(before, after, steps, "orders", ["order_hour_of_day", "order_dow"])
    keys = [k for k in (products, orders) if k is not None]
    for s in steps:
        if s.table == "order_details":
            keys += [k for k in (s.removed(), s.rows and s.added().select(*PRIMARY_KEYS["order_details"]))
                     if k is not None]
    department_hour, hour_dow = [(1, cells.department_hour)], [(1, cells.hour_dow)]
    for sign, t in ((-1, before), (1, after)):
        if keys:
            touched = Tables(**{**dict(t.items()), "order_details": _touched_lines(t, keys)})
            department_hour.append((sign, department_hour_totals(touched)))
        if orders is not None:
            hour_dow.append((sign, _hour_dow(t.orders.join(orders, "order_id", "left_semi"))))
    return Cells(_summed("department_hour", department_hour), _summed("hour_dow", hour_dow))


# ---- the reports -----------------------------------------------------------------
def orders_by_hour(cells: Cells) -> DataFrame:
    """R2 from cells."""
    return cells.hour_dow.groupBy("hour").agg(F.sum("orders").alias("orders")).orderBy(F.col("hour").asc_nulls_last())


def orders_by_dow(cells: Cells) -> DataFrame:
    """R3 from cells."""
    return (cells.hour_dow.groupBy("dow").agg(F.sum("orders").alias("orders"))
            .select("dow", dow_label("dow").alias("label"), "orders").orderBy(F.col("dow").asc_nulls_last()))


def _by_name(cells: Cells, departments: DataFrame) -> DataFrame:
    return (cells.department_hour.join(departments, "department_id").groupBy("department")
            .agg(F.sum("items").alias("items"), F.sum("reorders").alias("reorders")))


def top_departments(cells: Cells, departments: DataFrame, n: int = 10) -> DataFrame:
    """R4 from cells."""
    return (_by_name(cells, departments).select("department", "items")
            .orderBy(F.col("items").desc_nulls_first(), F.col("department").asc_nulls_last()).limit(n))


def reorder_rate_by_department(cells: Cells, departments: DataFrame, n: int = 10) -> DataFrame:
    """R5 from cells (an item is a line with a product id, as on audited tables every line is)."""
    return (_by_name(cells, departments).select("department", pct_half_up("reorders", "items", 1).alias("reorder_pct"))
            .orderBy(F.col("reorder_pct").desc_nulls_first(), F.col("department").asc_nulls_last()).limit(n))


def department_peak_hour(cells: Cells, departments: DataFrame) -> DataFrame:
    """R15 from cells."""
    return peak_hours(cells.department_hour, departments)
