"""Renames settled in rounds against one click after the other."""
import random

import pytest

from basketry.functions.components import components
from basketry.operators import catalog, settle
from conftest import rows


def replay(names, requests):
    """(seq -> status, names) of the valid requests, one after the other."""
    names, granted, status = dict(names), {}, {}
    for seq, id_, name in sorted(requests):
        if any(n == name and i != id_ for i, n in names.items()):
            status[seq] = "conflict"
            continue
        if id_ in granted:
            status[granted[id_]] = "superseded"
        names[id_], granted[id_], status[seq] = name, seq, "renamed"
    return status, names


def check(spark, names, requests, parts=3):
    dim = spark.createDataFrame(sorted(names.items()), "aisle_id long, aisle string")
    changes = spark.createDataFrame(requests, "seq long, id long, name string").repartition(parts)
    got = catalog.rename_names(dim, "aisle_id", "aisle", changes)
    status, after = replay(names, requests)
    assert {r[0]: r[1] for r in rows(got.outcomes)} == status
    assert dict(rows(got.table)) == after


def random_requests(seed, ids, free, n):
    r = random.Random(seed)
    names = {i: f"i{i}" for i in range(ids)}
    return names, [(k * 3 - 40, r.randrange(ids), f"i{r.randrange(ids)}" if r.random() < .4 else f"n{r.randrange(free)}")
                   for k in range(n)]


@pytest.mark.parametrize("seed, ids, free, n", [(1, 8, 5, 60), (2, 30, 40, 80)])
def test_random_change_sets(spark, seed, ids, free, n):
    check(spark, *random_requests(seed, ids, free, n))


def test_slices_carry_names_and_holders(spark, monkeypatch):
    monkeypatch.setattr(settle, "SLICE", 8)
    names, requests = random_requests(3, 7, 4, 40)
    assert settle._sliced(spark.createDataFrame(requests, "seq long, id long, name string"))[0].select(
        "slice").distinct().count() == 6
    check(spark, names, requests)


def test_chains_of_releases_and_of_refusals(spark):
    names = {i: f"i{i}" for i in range(8)}
    moved_up = [(0, 0, "free")] + [(i, i, f"i{i - 1}") for i in range(1, 8)]
    check(spark, names, moved_up)  # each takes the name that the one before gave up
    held = {**names, 99: "free"}
    check(spark, held, moved_up)  # the first is refused, and so all others
    check(spark, names, [(0, 0, "x"), (1, 1, "i0"), (2, 0, "i1"), (3, 0, "i0"), (4, 1, "i1"), (5, 0, "i0")])


def test_nothing_contested_and_nothing_at_all(spark):
    names = {1: "a", 2: "b"}
    check(spark, names, [(1, 1, "c"), (2, 2, "d"), (3, 1, "e")])
    check(spark, names, [])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 200), (200, 300), (5, 5), (300, 100), (100, 200)]
    edges += [(1000, i) for i in range(1001, 1100)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    expected = {i: 1 for i in range(1, 31)} | {i: 100 for i in (100, 200, 300)} | {i: 1000 for i in range(1000, 1100)}
    assert got == expected
    assert rows(components(spark.createDataFrame([(4, 4), (None, 1)], "a long, b long"))) == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_with_a_row_a_request_are_not_broadcast(spark):
    holders = spark.createDataFrame([(i, f"i{i}") for i in range(4)], "id long, name string")
    state, _ = settle._written(spark.range(500).selectExpr(
        "id AS seq", "int(id > 250) AS slice", "id % 4 AS id", "concat('n', id % 3) AS name", "true AS contested",
        "id % 5 = 0 AS granted"))
    plan = plan_of(settle._judge(state, holders, 2))
    assert "SortMergeJoin [id" in plan and "SortMergeJoin [name" in plan
    assert "BroadcastHashJoin [id" not in plan and "BroadcastHashJoin [name" not in plan
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "aisle_id long, aisle string")
    changes = spark.createDataFrame([(1, 1, "b"), (2, 2, "c"), (3, 1, "b")], "seq long, id long, name string")
    got = catalog.rename_names(dim, "aisle_id", "aisle", changes)
    assert "SortMergeJoin [seq" in plan_of(got.outcomes) and "BroadcastHashJoin [seq" not in plan_of(got.outcomes)
    assert "BroadcastHashJoin [seq" not in plan_of(got.table)
    assert sorted(rows(got.table)) == [(1, "b"), (2, "c")]
