"""Plan variants give the same rows: direct (proven-small products, audited
snapshot) vs eager per-product aggregation (lazy, unaudited tables), and the
shipped literal SQL forms vs the DataFrame rewrites."""

import os

import pytest

from basketry.plans import dashboard, departments, search
from basketry.sources import snapshot
from basketry.sources.fixture import fixture_tables, publish_fixture
from basketry.sources.sql import run_sql_file
from conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def both(spark):
    import tempfile
    root = tempfile.mkdtemp(prefix="basketry-eq-")
    publish_fixture(spark, SF_SMALL, root)
    snap = snapshot.read_snapshot(spark, root)
    return snap, fixture_tables(spark, SF_SMALL)


def test_snapshot_is_audited_with_counts(both):
    snap, lazy = both
    assert snap.audited and not lazy.audited
    assert snap.row_counts["products"] == lazy.products.count()
    assert snap.row_counts["order_details"] == lazy.order_details.count()


@pytest.mark.parametrize("fn", [
    departments.department_peak_hour, departments.department_stats,
    departments.department_hour_ranking, dashboard.top_departments,
    dashboard.reorder_rate_by_department, dashboard.kpis,
])
def test_direct_and_eager_plans_agree(both, fn):
    snap, lazy = both
    assert sorted(rows(fn(snap))) == sorted(rows(fn(lazy)))


def test_direct_plan_broadcasts_products_only_with_a_count(both):
    snap, lazy = both
    direct = departments.department_peak_hour(snap)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in direct.lower()
    unknown = snap.with_(users=snap.users)  # replaced data: counts unknown again
    assert unknown.row_counts is None


def test_literal_sql_forms_agree(both):
    snap, _ = both
    assert rows(run_sql_file(snap, "department_peak_hour.sql")) == rows(
        departments.department_peak_hour(snap))
    assert rows(search.product_search_sql(snap, "gear")) == rows(search.product_search(snap, "gear"))


def test_bucketed_snapshot_joins_lines_to_orders_without_exchange(spark, both):
    import tempfile
    _, lazy = both
    root = tempfile.mkdtemp(prefix="basketry-bk-")
    publish_fixture(spark, SF_SMALL, root, order_buckets_n=4)
    bk = snapshot.read_snapshot(spark, root)
    assert sorted(rows(departments.department_peak_hour(bk))) == sorted(
        rows(departments.department_peak_hour(lazy)))
    assert sorted(rows(search.product_search_hourly(bk, "", hours=(6, 17)))) == sorted(
        rows(search.product_search_hourly(lazy, "", hours=(6, 17))))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bk.order_details.join(bk.orders, "order_id", "left")._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_sql_file_percentage_does_not_round_twice(spark):
    """100 * 6622999 / 20000000 = 33.114995 must round to 33.11 (a 6-place
    decimal division would give 33.115 -> 33.12)."""
    from pyspark.sql import functions as F
    from conftest import make_tables
    n, s = 20_000_000, 6_622_999
    lines = spark.range(n).select(
        F.lit(1).cast("long").alias("order_id"), F.lit(10).cast("long").alias("product_id"),
        F.lit(1).cast("long").alias("add_to_cart_order"),
        F.when(F.col("id") < s, 1).otherwise(0).cast("long").alias("reordered"))
    t = make_tables(spark, departments=[(1, "d")], aisles=[(1, "a")], users=[(1,)],
                    products=[(10, "p", 1, 1)], orders=[(1, 1, "train", 2, 0, 9, 7.0)]
                    ).with_(order_details=lines)
    assert rows(run_sql_file(t, "department_peak_hour.sql")) == [("d", n, 33.11, 9)]
    assert rows(departments.department_peak_hour(t)) == [("d", n, 33.11, 9)]
