"""Cells and the name index through published changes; ids by rank."""
import os
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions import ids
from basketry.operators import changes
from basketry.operators.changes import Step
from basketry.plans import cells, dashboard, departments, search
from basketry.sources import name_index, snapshot
from conftest import make_tables, rows


@pytest.fixture()
def root(mini, scratch):
    snapshot.write_snapshot(mini, scratch)
    return scratch


def same_reports(spark, root):
    t, kept = snapshot.read_snapshot(spark, root), snapshot.read_cells(spark, root)
    assert rows(cells.orders_by_hour(kept)) == rows(dashboard.orders_by_hour(t))
    assert rows(cells.orders_by_dow(kept)) == rows(dashboard.orders_by_dow(t))
    assert rows(cells.top_departments(kept, t.departments)) == rows(dashboard.top_departments(t))
    assert rows(cells.reorder_rate_by_department(kept, t.departments)) == rows(dashboard.reorder_rate_by_department(t))
    assert rows(cells.department_peak_hour(kept, t.departments)) == rows(departments.department_peak_hour(t))
    fresh = cells.cells_of(t)
    for name, df in fresh.items():
        assert sorted(rows(df), key=str) == sorted(rows(getattr(kept, name)), key=str)


def test_cells_follow_every_kind_of_change(spark, root):
    with pytest.raises(FileNotFoundError):
        snapshot.read_cells(spark, root)
    version = snapshot.maintain_cells(spark, root)
    assert snapshot.maintain_cells(spark, root) == version
    same_reports(spark, root)
    make = lambda table, data: spark.createDataFrame(data, snapshot.SCHEMAS[table])
    keys = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} long")
    for steps in (
            # lines and orders come
            [Step("orders", rows=make("orders", [(103, 2, "train", 3, 6, 9, 1.0)])),
             Step("order_details", rows=make("order_details", [(103, 13, 1, 0), (103, 10, 2, 1)]))],
            # a product moves to another department, another only gets a name
            [Step("products", rows=make("products", [(12, "Milk", 2, 1), (10, "Bananas", 1, 1)]), replace=True)],
            # an order moves to another hour, its lines with it
            [Step("orders", rows=make("orders", [(100, 1, "train", 2, 3, 22, 7.0)]), replace=True)],
            # a line is replaced, another goes by its whole key
            [Step("order_details", rows=make("order_details", [(102, 12, 2, 0)]), replace=True),
             Step("order_details", gone=spark.createDataFrame([(101, 10)], "order_id long, product_id long"))],
            [Step("order_details", gone=keys("product_id", 11)), Step("products", gone=keys("product_id", 11))]):
        snapshot.publish_change(spark, root, steps)
        same_reports(spark, root)
    t = snapshot.read_snapshot(spark, root)
    snapshot.publish_change(spark, root, changes.cascade_steps(t, "users", keys("user_id", 1)))
    same_reports(spark, root)
    snapshot.compact(spark, root)
    same_reports(spark, root)


def test_literal_runs():
    assert name_index.literal_runs(r"%ab_c\%d\\%\_x%") == ["ab", r"c%d" + "\\", "_x"]
    assert name_index.literal_runs("%_%") == [] and name_index.literal_runs("a\\") == ["a\\"]


def test_index_narrows_and_never_decides(spark, root):
    snapshot.index_names(spark, root)
    names = [(20 + i, n, 1, 1) for i, n in enumerate(
        ["ΣΑΣ Öl", "straße", "a%b_c", "ab", "İstanbul çay", "banana split", "BANANA  Bread", "日本茶 green"])]
    add = spark.createDataFrame(names, snapshot.SCHEMAS["products"])
    snapshot.publish_change(spark, root, [Step("products", rows=add)])
    snapshot.publish_change(spark, root, [Step("products", rows=spark.createDataFrame(
        [(10, "Plantain", 1, 1)], snapshot.SCHEMAS["products"]), replace=True)])
    t, index = snapshot.read_snapshot(spark, root), snapshot.read_names(spark, root)
    for text in ("banana", "NANA", "ana", "σας", "ΣΑΣ", "STRASSE", "straß", r"a\%b", "a%b", "ab", "_", "istanbul", "İst",
                 "本茶 g", "ban%spl", "ba_ana", "nothing", "plantain", "  ", ""):
        assert rows(search.product_search(t, text, index=index)) == rows(search.product_search(t, text)), text
    assert sorted(r[0] for r in rows(index.candidates("%banana%"))) == [10, 11, 25, 26]  # 10 bears it no more
    assert rows(index.candidates("%xyzzy%")) == []
    assert index.candidates("%ab%") is None
    version = snapshot.index_names(spark, root)  # layers fold
    assert len(snapshot._marker(spark, version)["names"]) == 1


def test_index_reads_the_row_groups_of_its_trigrams(spark, scratch):
    products = spark.range(3000).select(F.col("id").alias("product_id"), F.concat(
        F.lit("name "), F.hex("id"), F.lit("x")).alias("product_name"))
    name_index.write(products, os.path.join(scratch, "i"))
    index = name_index.NameIndex.read(spark, [os.path.join(scratch, "i")])
    plan = index.candidates("%bb7x%")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    assert rows(index.candidates("%bb7x%")) == [(0xBB7,)]


@pytest.mark.parametrize("slice_rows", [200_000, 40])
def test_ids_by_rank(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(ids, "SLICE", slice_rows)
    seqs = random.Random(5).sample(range(-10 ** 12, 10 ** 12), 300)
    df = spark.createDataFrame([(s,) for s in seqs], "seq long").repartition(5)
    after = spark.createDataFrame([(41,)], "h long")
    got = {r.seq: r.id for r in ids.ids_by_rank(df, "seq", "id", after).collect()}
    assert got == {s: 42 + i for i, s in enumerate(sorted(seqs))}
    assert rows(ids.ids_by_rank(df.limit(0), "seq", "id", after)) == []


def test_unions_of_layers_do_not_pass_partitioning_on(spark, root):
    """A join above such a union failed where adaptive execution replanned one of
    the inputs; so the union's rows are dealt again for the aggregate."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")  # as in a session made elsewhere
    try:
        products = snapshot.read_snapshot(spark, root).products.repartition(3, "product_id")
        both = products.unionByName(products).groupBy("product_id").count()
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Exchange hashpartitioning") < plan.index("Union")
        assert {r[1] for r in rows(both)} == {2}
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
