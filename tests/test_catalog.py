"""Change-set operators on the `mini` frame (FIXTURES.md §3)."""

import pytest

from basketry.operators import catalog
from conftest import make_tables, rows


def _outcomes(res):
    return sorted(rows(res.outcomes))


def test_insert_aisles_rules(spark, mini):
    changes = spark.createDataFrame(
        [(1, " milk "), (2, "tea"), (3, "tea"), (4, "  "), (5, "coffee"), (6, "x" * 256)],
        "seq long, name string")
    res = catalog.insert_names(mini.aisles, "aisle_id", "aisle", changes)
    assert _outcomes(res) == [(1, "exists", 2, None), (2, "inserted", 3, None),
                              (3, "duplicate", 3, None), (4, "blank", None, None),
                              (5, "inserted", 4, None), (6, "too long", None, None)]
    assert sorted(rows(res.table)) == [(1, "fresh fruits"), (2, "milk"), (3, "tea"), (4, "coffee")]


def test_insert_into_empty_table_starts_at_two(spark):
    empty = make_tables(spark).aisles
    changes = spark.createDataFrame([(7, "first")], "seq long, name string")
    assert _outcomes(catalog.insert_names(empty, "aisle_id", "aisle", changes)) == [
        (7, "inserted", 2, None)]


def test_python_strip_semantics(spark, mini):
    ws = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    changes = spark.createDataFrame([(1, ws + "spice" + ws), (2, ws)], "seq long, name string")
    res = catalog.insert_names(mini.aisles, "aisle_id", "aisle", changes)
    assert _outcomes(res) == [(1, "inserted", 3, None), (2, "blank", None, None)]
    assert ("spice" == (ws + "spice" + ws).strip()) and rows(
        res.table.filter("aisle_id = 3")) == [(3, "spice")]


def test_rename_rules(spark, mini):
    changes = spark.createDataFrame(
        [(1, 1, "fruit"), (2, 1, " fresh fruit "), (3, 2, "fresh fruit"), (4, 9, "ghost"),
         (5, 2, ""), (6, 3, "empty")], "seq long, id long, name string")
    res = catalog.rename_names(mini.aisles, "aisle_id", "aisle", changes)
    # the first of two takers gets "fresh fruit"; the other keeps its name
    assert _outcomes(res) == [(1, "superseded", 1, None),
                              (2, "renamed", 1, None), (3, "conflict", 2, None),
                              (4, "unknown", 9, None), (5, "blank", 2, None),
                              (6, "unknown", 3, None)]
    assert sorted(rows(res.table)) == [(1, "fresh fruit"), (2, "milk")]
    ok = catalog.rename_names(mini.aisles, "aisle_id", "aisle", spark.createDataFrame(
        [(1, 2, "dairy milk"), (2, 1, "fresh fruits")], "seq long, id long, name string"))
    assert sorted(rows(ok.table)) == [(1, "fresh fruits"), (2, "dairy milk")]
    # a refused request does not undo an earlier one, and a name given up is free:
    # 1 -> x, 1 -> milk (taken), 2 -> fresh fruits (free by now), 1 -> milk (free by now)
    swap = catalog.rename_names(mini.aisles, "aisle_id", "aisle", spark.createDataFrame(
        [(4, 1, "milk"), (1, 1, "x"), (3, 2, "fresh fruits"), (2, 1, "milk")],
        "seq long, id long, name string"))
    assert _outcomes(swap) == [(1, "superseded", 1, None), (2, "conflict", 1, None),
                               (3, "renamed", 2, None), (4, "renamed", 1, None)]
    assert sorted(rows(swap.table)) == [(1, "milk"), (2, "fresh fruits")]


def test_guarded_deletes(spark, mini):
    req = spark.createDataFrame([(1, 2)], "seq long, id long")
    res = catalog.guarded_delete(mini.aisles, "aisle_id", mini.products, req)
    assert _outcomes(res) == [(1, "in use", 2, "1")]
    req = spark.createDataFrame([(1, 3), (2, 42)], "seq long, id long")
    res = catalog.guarded_delete(mini.departments, "department_id", mini.products, req)
    assert _outcomes(res) == [(1, "deleted", 3, None), (2, "unknown", 42, None)]
    assert sorted(r[0] for r in rows(res.table)) == [1, 2]


def test_insert_and_update_products(spark, mini):
    ins = spark.createDataFrame(
        [(1, " Kiwi ", 1, 1), (2, "Kiwi", 1, 1), (3, "", 1, 1), (4, "Tea", 9, 1), (5, "Tea", 1, 9)],
        "seq long, product_name string, aisle_id long, department_id long")
    res = catalog.insert_products(mini, ins)
    assert _outcomes(res) == [(1, "inserted", 14, None), (2, "inserted", 15, None),
                              (3, "blank", None, None), (4, "unknown aisle", None, None),
                              (5, "unknown department", None, None)]
    upd = spark.createDataFrame(
        [(1, 12, "Whole Milk", 2, 2), (2, 12, "Milk 1L", 2, 1), (3, 12, " ", 2, 2),
         (4, 99, "Nope", 1, 1), (5, 10, "Banana", 1, 7)],
        "seq long, product_id long, product_name string, aisle_id long, department_id long")
    res = catalog.update_products(mini, upd)
    assert _outcomes(res) == [(1, "superseded", 12, None), (2, "updated", 12, None),
                              (3, "blank", 12, None), (4, "unknown", 99, None),
                              (5, "unknown department", 10, None)]
    assert sorted(rows(res.table))[2] == (12, "Milk 1L", 2, 1)


def test_high_water_mark(spark, mini):
    assert rows(catalog.high_water_mark(mini.products, "product_id")) == [(13,)]
    assert rows(catalog.high_water_mark(make_tables(spark).products, "product_id")) == [(1,)]


def test_cascades(spark, mini):
    ids = spark.createDataFrame([(10,)], "id long")
    after = catalog.cascade_delete(mini, "products", ids)
    assert after.order_details.count() == 3 and after.products.count() == 3
    after = catalog.cascade_delete(mini, "users", spark.createDataFrame([(1,)], "id long"))
    assert [r.order_id for r in after.orders.collect()] == [102]
    assert after.order_details.count() == 2 and after.users.count() == 1
    after = catalog.cascade_delete(mini, "aisles", spark.createDataFrame([(1,)], "id long"))
    assert sorted(r.product_id for r in after.products.collect()) == [12]
    assert sorted(rows(after.order_details)) == [(100, 12, 2, 0), (102, 12, 2, 1)]
    both = catalog.delete_products(mini, ids)
    assert both.products.count() == 3 and both.order_details.count() == 3


def test_a_repeated_seq_is_refused(spark, mini):
    twice = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "seq long, id long, name string")
    for result in (
            lambda: catalog.insert_names(mini.aisles, "aisle_id", "aisle", twice.select("seq", "name")),
            lambda: catalog.rename_names(mini.aisles, "aisle_id", "aisle", twice)):
        with pytest.raises(Exception, match="repeated seq"):
            result().outcomes.collect()
