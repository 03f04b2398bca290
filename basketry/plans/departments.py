"""Department summary with peak hour (R15) and its two parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.numeric import pct_half_up
from basketry.plans.facts import department_hour_totals, department_line_totals
from basketry.tables import Tables


def _peak_order(w):
    # Hours with no matched order line never rank; ties go to the lowest hour.
    return w.orderBy((F.col("lines") > 0).desc(), F.col("lines").desc(),
                     F.col("hour").asc_nulls_last())


def department_stats(t: Tables) -> DataFrame:
    """(department_id, department, items_sold, reorder_pct[2 dp])."""
    totals = department_line_totals(t)
    return (t.departments.join(totals, "department_id")
            .select("department_id", "department",
                    F.col("items").alias("items_sold"),
                    pct_half_up("reorders", "items", 2).alias("reorder_pct")))


def department_hour_ranking(t: Tables) -> DataFrame:
    """(department_id, hour, lines, rank) — order lines per hour, ranked."""
    facts = department_hour_totals(t).filter(F.col("lines") > 0)
    facts = facts.join(t.departments.select("department_id"), "department_id")
    w = Window.partitionBy("department_id")
    return facts.select("department_id", "hour", "lines",
                        F.row_number().over(_peak_order(w)).cast("bigint").alias("rank"))


def department_peak_hour(t: Tables) -> DataFrame:
    """R15 (flagship): department, items_sold, reorder_pct, peak_hour.

    One scan of the lines: per (department, hour) totals feed both the
    department statistics (window sums over at most 25 hour rows) and the
    hour ranking; only the rank-1 hour survives (``WindowGroupLimit``).
    """
    return peak_hours(department_hour_totals(t), t.departments)


def peak_hours(facts: DataFrame, departments: DataFrame) -> DataFrame:
    """R15 from the totals per department and hour."""
    w = Window.partitionBy("department_id")
    ranked = facts.select(
        "department_id", "hour", "lines",
        F.sum("items").over(w).alias("items_sold"),
        F.sum("reorders").over(w).alias("reorders"),
        F.row_number().over(_peak_order(w)).alias("_rn"))
    peak = ranked.filter((F.col("_rn") == 1) & (F.col("lines") > 0))
    return (departments.join(peak, "department_id")
            .select("department", "items_sold",
                    pct_half_up("reorders", "items_sold", 2).alias("reorder_pct"),
                    F.col("hour").alias("peak_hour"))
            .orderBy(F.col("items_sold").desc_nulls_first(), F.col("department").asc_nulls_last()))
