"""Published change sets: layers, refusals, two writers, the command line."""
import json
import os
import time

import pytest

from basketry import __main__ as cli
from basketry.operators import catalog, changes
from basketry.operators.audit import audit
from basketry.operators.changes import Step
from basketry.sources import snapshot
from conftest import rows


@pytest.fixture()
def root(mini, scratch):
    snapshot.write_snapshot(mini, scratch)
    return scratch


def read(spark, root):
    return {name: sorted(rows(df)) for name, df in snapshot.read_snapshot(spark, root).items()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_every_catalogue_edit_can_be_published(spark, root):
    def publish(make):
        t = snapshot.read_snapshot(spark, root)
        result = make(t)
        steps = result if isinstance(result, list) else [result.step]
        expected = {n: sorted(rows(df)) for n, df in changes.apply(t, steps).items()}
        if not isinstance(result, list):  # the step and the new table say the same
            assert expected[steps[0].table] == sorted(rows(result.table))
        snapshot.publish_change(spark, root, steps)
        assert read(spark, root) == expected

    frame = lambda data, schema: spark.createDataFrame(data, schema)
    publish(lambda t: catalog.insert_names(t.aisles, "aisle_id", "aisle", frame(
        [(1, "tea"), (2, "milk"), (3, " ")], "seq long, name string")))
    publish(lambda t: catalog.rename_names(t.aisles, "aisle_id", "aisle", frame(
        [(1, 3, "green tea"), (2, 2, "dairy"), (3, 1, "milk")], "seq long, id long, name string")))
    publish(lambda t: catalog.guarded_delete(t.departments, "department_id", t.products, frame(
        [(1, 3), (2, 1)], "seq long, id long")))
    new = "seq long, product_name string, aisle_id long, department_id long"
    publish(lambda t: catalog.insert_products(t, frame([(1, "Kiwi", 1, 1), (2, "Tea", 3, 2)], new)))
    publish(lambda t: catalog.update_products(t, frame(
        [(1, 14, "Kiwi gold", 1, 2), (2, 10, "Banana", 1, 2)],
        "seq long, product_id long, product_name string, aisle_id long, department_id long")))
    publish(lambda t: catalog.product_removal(frame([(10,), (99,)], "product_id long")))
    publish(lambda t: changes.cascade_steps(t, "users", frame([(2,)], "user_id long")))
    # a key that went may come again, and is not hidden by its tombstone
    publish(lambda t: [Step("users", rows=frame([(2,)], "user_id long"))])
    t = snapshot.read_snapshot(spark, root)
    assert t.audited and rows(audit(t)) == []
    before, version = read(spark, root), snapshot.compact(spark, root)
    assert read(spark, root) == before
    marker = snapshot._marker(spark, version)
    assert all(len(layers) == 1 for layers in marker["layers"].values())
    assert {n: marker["row_counts"][n] for n in before} == {n: len(r) for n, r in before.items()}
    assert snapshot.compact(spark, root) == version  # nothing to fold


def test_a_delete_writes_its_keys_only(spark, scratch):
    from conftest import make_tables
    n = 3000
    big = make_tables(spark, users=[(1,)], departments=[(1, "d")], aisles=[(1, "a")], products=[(1, "p", 1, 1)],
                      orders=[(i, 1, "train", 1, 0, 0, 1.0) for i in range(n)],
                      order_details=[(i, 1, 1, 0) for i in range(n)])
    base = snapshot.write_snapshot(big, scratch)
    steps = changes.cascade_steps(snapshot.read_snapshot(spark, scratch), "orders",
                                  spark.createDataFrame([(5,), (7,)], "order_id long"))
    version = snapshot.publish_change(spark, scratch, steps)
    assert size(version) < size(base) / 5
    t = snapshot.read_snapshot(spark, scratch)
    assert t.orders.count() == t.order_details.count() == n - 2
    layers = snapshot._marker(spark, version)["layers"]
    assert layers["products"] == [{"rows": f"{os.path.basename(base)}/products"}]  # by reference


def test_a_broken_rule_publishes_nothing(spark, root):
    before = read(spark, root)
    for steps, rule in (
            ([Step("products", gone=spark.createDataFrame([(12,)], "product_id long"))], "foreign key product_id"),
            ([Step("aisles", rows=spark.createDataFrame([(2, "again")], "aisle_id long, aisle string"))], "primary key"),
            ([Step("aisles", rows=spark.createDataFrame([(9, "milk")], "aisle_id long, aisle string"))], "unique"),
            ([Step("orders", rows=spark.createDataFrame(
                [(900, 77, "train", 0, 0, 9, 7.0)], snapshot.SCHEMAS["orders"]))], "foreign key user_id")):
        with pytest.raises(snapshot.SnapshotRejected, match=rule):
            snapshot.publish_change(spark, root, steps)
        assert read(spark, root) == before


def test_of_two_writers_one_loses(spark, root):
    base = snapshot.latest_version(spark, root)
    step = lambda i, name: [Step("aisles", rows=spark.createDataFrame([(i, name)], "aisle_id long, aisle string"))]
    won = snapshot.publish_change(spark, root, step(3, "tea"), base)
    with pytest.raises(snapshot.SnapshotConflict):
        snapshot.publish_change(spark, root, step(3, "coffee"), base)
    assert snapshot.latest_version(spark, root) == won
    # both are past the first look: the claim decides
    second, third = (snapshot.new_version(root, won) for _ in range(2))
    snapshot._follow(spark, won, second)
    with pytest.raises(snapshot.SnapshotConflict):
        snapshot._follow(spark, won, third)
    # the claim of a writer that died is void after a while
    claim = os.path.join(won, snapshot.CLAIM)
    with open(claim) as f:
        held = json.load(f)
    held["claimed_ms"] = int((time.time() - snapshot.CLAIM_SECONDS - 1) * 1000)
    for name in (claim, os.path.join(won, f".{snapshot.CLAIM}.crc")):
        os.remove(name)
    with open(claim, "w") as f:
        json.dump(held, f)
    assert snapshot.publish_change(spark, root, step(4, "coffee")) == snapshot.latest_version(spark, root)
    assert (4, "coffee") in read(spark, root)["aisles"]


def test_delta_audit_of_nothing_and_of_untouched_rules(spark, mini):
    assert rows(changes.audit_delta(mini, [])) == []
    same = [Step("aisles", rows=mini.aisles, replace=True)]
    assert rows(changes.audit_delta(mini, same)) == []


def test_command_line_edit_and_compact(spark, root, scratch, capsys):
    path = os.path.join(scratch, "changes.csv")
    with open(path, "w") as f:
        f.write("seq,name\n1,tea\n2,milk\n")
    assert cli.main(["edit", "insert_aisles", root, path]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out == ["seq\tstatus\tid\tdetail", "1\tinserted\t3\tNULL", "2\texists\t2\tNULL"]
    assert (3, "tea") in read(spark, root)["aisles"]
    assert cli.main(["compact", root]) == 0
    assert (3, "tea") in read(spark, root)["aisles"]
