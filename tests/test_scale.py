"""Plans that keep what a task holds, and what is shuffled and spilled, in bounds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import changes, load
from basketry.plans.departments import department_peak_hour
from basketry.sources import csv, fixture


@pytest.fixture()
def sf_dir(spark, tmp_path):
    day = dt.datetime(2020, 1, 1)
    frames = {
        "part": ([(1, "red gear", "B1", "T1"), (2, "blue gear", "B2", "T1")],
                 "p_partkey bigint, p_name string, p_brand string, p_type string"),
        "orders": ([(k, 1, day + dt.timedelta(days=k), "1-URGENT" if k == 3 else "5-LOW") for k in range(1, 5)],
                   "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, "N"), (2, 1, 2, "R"), (2, 1, 1, "N"), (2, 2, 3, "N"), (3, 2, 1, "N"), (9, 1, 1, "N"),
                      (None, 1, 1, "N"), (4, None, 1, "R")],
                     "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_lines_are_dealt_once_by_order(spark, sf_dir, monkeypatch):
    """no aggregate of (order, product) over a scan, tasks by the input's size."""
    monkeypatch.setattr(fixture, "LINE_BYTES", 100)
    t = fixture.fixture_tables(spark, sf_dir)
    plan = _plan(department_peak_hour(t))
    assert "hashpartitioning(order_id#" in plan and "REPARTITION_BY_NUM" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "order_id#" in line and "product_id#" in line.split("hashpartitioning")[-1].split(")")[0]]
    rows = {tuple(r) for r in t.order_details.collect()}
    assert rows == {(2, 1, 1, 1), (2, 2, 3, 0), (3, 2, 1, 0), (4, None, 1, 1)}
    monkeypatch.setattr(fixture, "LINE_BYTES", 1 << 30)
    assert {tuple(r) for r in fixture.fixture_tables(spark, sf_dir).order_details.collect()} == rows


def test_incomplete_rows_go_before_the_joins(spark, sf_dir):
    """completeness is judged per column, so columns that a table lacks do not travel."""
    orders = load.normalise(fixture.fixture_wide(spark, sf_dir)).orders
    assert "atleastnnonnulls" not in _plan(orders).lower()
    exchanges = [line for line in _plan(orders).splitlines() if "Project" in line]
    assert exchanges and not [line for line in exchanges if "product_name" in line and "user_id" in line]
    assert {r["order_id"] for r in orders.collect()} == {2, 3}


def test_lines_are_not_sorted_by_product(spark, sf_dir):
    """the wide rows' join with products too many to broadcast holds no lines."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = fixture.fixture_wide(spark, sf_dir)
        plan = _plan(wide)
        found = sorted((r["order_id"], r["product_name"], r["aisle"], r["department"]) for r in wide.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin [product_id#" in plan and "Sort [product_id#" not in plan
    assert found == [(1, "red gear", "T1", "B1"), (2, "blue gear", "T1", "B2"), (2, "red gear", "T1", "B1"),
                     (3, "blue gear", "T1", "B2"), (3, "blue gear", "T1", "B2")]


def test_complete_rows_drop_null_and_nan(spark):
    wide = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, "b", float("nan")), (None, "c", 1.0), (4, "d", None)],
                                 "k bigint, name string, gap double")
    assert load.complete_rows(wide).collect() == wide.na.drop("any").collect() == wide.filter("k = 1").collect()


def test_splits_are_counted_without_sorting_lines(spark, tmp_path):
    """The count of quotes per split holds no lines."""
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,\"4\n\"\n")
    (tmp_path / "b.csv").write_text("y,x\n")
    (tmp_path / "c.csv").write_text("")
    found = csv._splits(spark, str(tmp_path), "UTF-8")
    plan = _plan(found)
    assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan
    rows = found.select(F.element_at(F.split("_file", "/"), -1).alias("f"), "lines", "folded", "header").collect()
    assert sorted(tuple(r) for r in rows) == [("a.csv", 4, True, "x,y"), ("b.csv", 1, False, "y,x")]


@pytest.mark.parametrize("task_keys", [1, 1 << 30])
def test_repeated_keys_of_a_change_are_found_without_a_join(spark, monkeypatch, task_keys):
    """F32: one shuffle of the keys, in tasks by the number of kept rows."""
    monkeypatch.setattr(changes, "TASK_KEYS", task_keys)
    schema = "order_id bigint, product_id bigint"
    kept = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 4), (4, 5)], schema)
    new = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, None), (None, 1), (None, 1), (4, 4), (5, 5)], schema)
    found = changes._twice("order_details", "primary key", ["order_id", "product_id"], kept, new, 100)
    assert "Join" not in _plan(found)
    assert ("REPARTITION_BY_NUM" in _plan(found)) == (task_keys == 1)
    assert [tuple(r) for r in found.collect()] == [("order_details", "primary key (order_id, product_id)", 3)]
