"""Every registered query against its DuckDB oracle on the sf0.001 inputs,
plus plan checks: no cartesian / nested-loop joins and no Python UDF nodes."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from basketry import registry
from conftest import SF_SMALL

# the queries of the llm subpackage have their own tests in tests/llm
QUERIES = {k: f for k, f in entry.queries().items() if k in registry.QUERIES}
ORACLE = {k: sql for k, sql in entry.oracle_sql().items() if k in registry.QUERIES}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "PythonUDF", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups"]
# columns the mapping needs from each input (of 11 / 6 / 6 / 5 in the files)
MAX_READ = {"lineitem": 4, "orders": 4, "part": 5, "customer": 2, "derived orders": 8}
# the inputs, and the copies that the mapping derives from them
SCAN = re.compile(r"FileScan parquet \[([^\]]*)\].*?Location: [^\[]*\[file:[^\]]*?/(?:(\w+)\.parquet|fixture-(\w+?)-[\d-]+)\]")


def _scans(query):
    """(columns, table) of every scan of a plan."""
    return [(cols, a or f"derived {b}") for cols, a, b in SCAN.findall(query)]


def _check_pruning(name, plan):
    for cols, table in _scans(plan):
        n = len([c for c in cols.split(",") if c.strip()])
        assert n <= MAX_READ.get(table, n), f"{name}: {table} scan reads {n} columns"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ["part", "orders", "lineitem", "customer"]:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    return con


def _norm(row, order):
    out = []
    for i in order:
        v = row[i]
        out.append(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v)
    return tuple(out)


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((_norm(r, order) for r in data), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in FORBIDDEN:
        assert node not in plan, f"{name}: {node} in plan"
    _check_pruning(name, plan)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _canon(df.columns, got) == _canon(cols, cur.fetchall())


def test_no_window_takes_a_whole_table(spark):
    """A window without PARTITION BY only numbers the partitions of new ids."""
    seen = 0
    for name, query in QUERIES.items():
        plan = query(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        # a window definition that begins with its order has no partition
        for first in re.findall(r"windowspecdefinition\((\w+)#\d+L? (?:ASC|DESC)", plan):
            assert first == "_part", f"{name}: {first}"
            seen += 1
    assert seen  # the ids of inserts


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["department", "items_sold", "reorder_pct", "peak_hour"]
    assert df.count() > 0


def test_pruning_check_sees_scans(spark):
    plan = QUERIES["kpis"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert {t for _, t in _scans(plan)} >= {"derived orders", "lineitem", "part"}
    # of the derived orders: their id and their gap
    assert max(len(cols.split(",")) for cols, t in _scans(plan) if t == "derived orders") == 2


def test_the_banded_join_stays_an_outer_join(spark):
    """The band filters the orders' side of the join, which keeps all lines."""
    for name in ("product_search_banded_orders", "product_search_banded_sql"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        outer = [line for line in plan.splitlines() if "Join LeftOuter" in line and "order_id" in line]
        assert len(outer) == 1, plan
        at = plan.index(outer[0])
        assert re.search(r"order_hour_of_day#\d+L >= 6\).*order_hour_of_day#\d+L <= 17", plan[at:])
