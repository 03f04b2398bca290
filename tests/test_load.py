"""CSV source, cleaning, normalisation, audit and snapshots (FIXTURES.md §4)."""

import os

import pytest
from pyspark.sql import functions as F

from basketry.operators import load
from basketry.operators.audit import audit
from basketry.plans import dashboard
from basketry.sources import snapshot
from basketry.sources.csv import read_wide_csv
from conftest import make_tables, rows

HEADER = ("order_id,product_id,add_to_cart_order,reordered,user_id,eval_set,order_number,"
          "order_dow,order_hour_of_day,days_since_prior_order,product_name,aisle_id,"
          "department_id,aisle,department\n")
GOOD = [
    '100,10,1,1,1,train,2,0,9,7.0,Banana,1,1,fresh fruits,produce\n',
    '100,12,2,0,1,train,2,0,9,7.0,Milk,2,2,milk,dairy eggs\n',
    '101,10,1,1,1,train,3,6,9,8.0,Banana,1,1,fresh fruits,produce\n',
    '102,11,1,0,2,train,2,0,14,30.0,"Choc ""Big"" Bar, 2",1,1,fresh fruits,produce\n',
]


def _csv(scratch, lines, name="wide.csv", header=HEADER):
    path = os.path.join(scratch, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(header + "".join(lines))
    return path


def test_quotes_dedup_and_incomplete_rows(spark, scratch):
    lines = GOOD + [GOOD[0],  # exact duplicate
                    '103,10,1,1,1,train,1,0,9,,Banana,1,1,fresh fruits,produce\n',  # null gap
                    '104,10,1,1,1,train,4,0,9,3.0,NA,1,1,fresh fruits,produce\n',  # NA token
                    '105,10,1,1,1,train,5,0,9,3.0,None,1,1,fresh fruits,produce\n']
    wide = read_wide_csv(spark, _csv(scratch, lines))
    clean = load.clean_wide(wide)
    assert clean.count() == 4
    names = sorted(r.product_name for r in clean.select("product_name").distinct().collect())
    assert names == ["Banana", 'Choc "Big" Bar, 2', "Milk"]
    t = load.normalise(wide)
    assert sorted(rows(t.orders.select("order_id"))) == [(100,), (101,), (102,)]
    assert rows(audit(t)) == []


def test_integral_floats_and_defaults(spark, scratch):
    header = "order_id,product_id,add_to_cart_order,user_id,order_number,order_dow," \
             "order_hour_of_day,days_since_prior_order,product_name,aisle_id,department_id," \
             "aisle,department\n"
    lines = ["100.0,10,1,1,2,0,9,7,Banana,1.0,1,fresh fruits,produce\n"]
    t = load.normalise(read_wide_csv(spark, _csv(scratch, lines, header=header)))
    assert rows(t.orders) == [(100, 1, "train", 2, 0, 9, 7.0)]
    assert rows(t.order_details) == [(100, 10, 1, 0)]


def test_keep_first_name_in_file_order(spark, scratch):
    lines = GOOD + ['106,12,1,0,2,train,3,1,10,5.0,Milk,2,2,milk,DAIRY\n']
    t = load.normalise(read_wide_csv(spark, _csv(scratch, lines)))
    assert sorted(rows(t.departments)) == [(1, "produce"), (2, "dairy eggs")]
    lines = ['106,12,1,0,2,train,3,1,10,5.0,Milk,2,2,milk,DAIRY\n'] + GOOD
    t = load.normalise(read_wide_csv(spark, _csv(scratch, lines, name="b.csv")))
    assert sorted(rows(t.departments)) == [(1, "produce"), (2, "DAIRY")]


def _violations(t):
    return sorted((r.table, r.rule, r.violations) for r in audit(t).collect())


def test_audit_rules(spark, scratch):
    bad = GOOD + [
        '107,13,1,0,2,train,3,1,10,5.0,Tea,3,3,tea,produce\n',  # "produce" under two ids
        '108,10,1,0,2,train,4,1,10,5.0,Banana split,1,1,fresh fruits,produce\n',  # 2 names, id 10
    ]
    t = load.normalise(read_wide_csv(spark, _csv(scratch, bad)))
    assert _violations(t) == [("departments", "unique (department)", 1),
                              ("products", "primary key (product_id)", 1)]


def test_audit_checks_lengths_and_orphans(spark):
    t = make_tables(
        spark, users=[(1,)], departments=[(1, "d" * 256)], aisles=[(1, "a")],
        products=[(10, "p", 1, 1)],
        orders=[(100, 1, "train", 0, 7, 24, -1.0), (101, 1, "train", None, None, None, None)],
        order_details=[(100, 10, 0, 2), (101, 99, 1, None)])
    assert _violations(t) == [
        ("departments", "length department <= 255", 1),
        ("order_details", "check add_to_cart_order > 0", 1),
        ("order_details", "check reordered in (0, 1)", 1),
        ("order_details", "foreign key product_id -> products.product_id", 1),
        ("orders", "check days_since_prior_order >= 0", 1),
        ("orders", "check order_dow between 0 and 6", 1),
        ("orders", "check order_hour_of_day between 0 and 23", 1),
        ("orders", "check order_number > 0", 1),
    ]


def test_snapshot_publication(spark, scratch):
    root = os.path.join(scratch, "snap")
    wide = read_wide_csv(spark, _csv(scratch, GOOD))
    v1 = snapshot.load_wide(wide, root)
    got = snapshot.read_snapshot(spark, root)
    assert rows(dashboard.kpis(got)) == rows(dashboard.kpis(load.normalise(wide)))
    bad = GOOD + ['107,13,1,0,2,train,3,1,10,5.0,Tea,3,3,tea,produce\n']
    with pytest.raises(snapshot.SnapshotRejected) as err:
        snapshot.load_wide(read_wide_csv(spark, _csv(scratch, bad, name="bad.csv")), root)
    assert ("departments", "unique (department)", 1) in err.value.violations
    assert snapshot.latest_version(spark, root) == v1  # the rejected load stays invisible
    unparsable = GOOD + ['1x9,13,1,0,2,train,3,1,10,5.0,Tea,3,3,tea,produce\n']
    with pytest.raises(snapshot.SnapshotRejected) as err:
        snapshot.load_wide(read_wide_csv(spark, _csv(scratch, unparsable, name="c.csv")), root)
    assert err.value.violations == [("wide", "parse order_id", 1)]


def test_empty_snapshot_metrics(spark, scratch):
    root = os.path.join(scratch, "empty")
    v = snapshot.write_snapshot(make_tables(spark), root)
    t = snapshot.read_snapshot(spark, root)
    assert snapshot.latest_version(spark, root) == v
    assert rows(dashboard.kpis(t)) == [(0, 0, None, None)]
    assert dashboard.orders_by_hour(t).count() == 0


def test_audited_snapshot_kpis_match_exact_path(spark, scratch):
    root = os.path.join(scratch, "aud")
    wide = read_wide_csv(spark, _csv(scratch, GOOD))
    snapshot.load_wide(wide, root)
    t = snapshot.read_snapshot(spark, root)
    assert t.audited and not t.with_(users=t.users).audited
    assert rows(dashboard.kpis(t)) == rows(dashboard.kpis(t.with_(users=t.users)))


def test_create_if_absent_is_idempotent(spark, scratch):
    root = os.path.join(scratch, "fresh")
    v1 = snapshot.create_if_absent(spark, root)
    assert snapshot.create_if_absent(spark, root) == v1
    t = snapshot.read_snapshot(spark, root)
    assert t.row_counts == {name: 0 for name, _ in t.items()}


def test_multiline_csv_field(spark, scratch):
    line = '109,14,1,0,2,train,3,1,10,5.0,"Two\nLines",1,1,fresh fruits,produce\n'
    wide = read_wide_csv(spark, _csv(scratch, GOOD + [line], name="ml.csv"), multiline=True)
    names = {r.product_name for r in load.normalise(wide).products.collect()}
    assert "Two\nLines" in names


def test_cli_load_and_show(spark, scratch, capsys):
    from basketry.__main__ import main
    root = os.path.join(scratch, "cli")
    assert main(["load", _csv(scratch, GOOD, name="cli.csv"), root]) == 0
    assert main(["show", "kpis", root]) == 0
    out = capsys.readouterr().out
    assert "total_orders" in out


def test_cli_parameters_and_whole_results(spark, scratch, capsys):
    from basketry.__main__ import main
    root = os.path.join(scratch, "cli2")
    many = [f"{i},{i},1,1,1,train,2,0,9,7.0,P{i:03d},1,1,a,d\n" for i in range(1, 81)]
    assert main(["load", _csv(scratch, many, name="many.csv"), root]) == 0
    capsys.readouterr()
    assert main(["show", "products", root]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 81  # header and every row
    assert main(["show", "product_search", root, "--param", "text=p07", "--param", "hour_from=3"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 11
    assert main(["show", "lookup_aisles", root, "--param", "name=a", "--limit", "1"]) == 0
    assert capsys.readouterr().out.splitlines() == ["aisle\taisle_id", "a\t1"]
    sql = os.path.join(scratch, "q.sql")
    with open(sql, "w", encoding="utf-8") as f:
        f.write("SELECT product_id FROM products WHERE product_name = :n;")
    assert main(["sql", sql, root, "--param", "n=P007"]) == 0
    assert capsys.readouterr().out.splitlines() == ["product_id", "7"]
    out = os.path.join(scratch, "out")
    assert main(["show", "kpis", root, "--out", out]) == 0 and spark.read.parquet(out).count() == 1
    with pytest.raises(SystemExit):
        main(["show", "kpis", root, "--param", "text=x"])


def _swapped(line):
    f = line.rstrip("\n").split(",")
    f[4], f[12] = f[12], f[4]  # user_id and department_id
    return ",".join(f) + "\n"


def test_every_file_has_its_own_header(spark, scratch):
    folder = os.path.join(scratch, "two")
    os.mkdir(folder)
    names = HEADER.strip().split(",")
    names[4], names[12] = names[12], names[4]
    _csv(folder, GOOD[:2], name="a.csv")
    _csv(folder, [_swapped(GOOD[2])], name="b.csv", header=",".join(names) + "\n")
    wide = read_wide_csv(spark, folder)
    assert sorted(rows(wide.select("order_id", "user_id", "department_id"))) == [
        (100, 1, 1), (100, 1, 2), (101, 1, 1)]
    _csv(folder, [], name="c.csv", header="other,names\n")
    with pytest.raises(ValueError, match="different columns"):
        read_wide_csv(spark, folder)
    with pytest.raises(ValueError, match="repeated"):
        read_wide_csv(spark, _csv(scratch, [], name="d.csv", header="a,b,a\n"))


def test_ragged_and_unparsable_lines_are_not_lost(spark, scratch):
    lines = GOOD + [
        GOOD[0].rstrip("\n") + ",surplus\n",
        '100,13,1,0,1,train,2,0,9,7.0,"a, b",1,1,fresh fruits,produce\n',  # a quoted comma is no field
        '104,10,1,1,1,train,4,0,9\n',  # short: missing values
        '105,x,1,1,1,train,4,0,9,3.0,Tea,1,1,fresh fruits,produce\n',
        '106,x,1,1,1,train,4,0,9,,Tea,1,1,fresh fruits,produce\n']  # removed anyway: no day gap
    wide = read_wide_csv(spark, _csv(scratch, lines, name="ragged.csv"))
    got = load.rejects(wide).select("rule", "violations")
    assert sorted(rows(got)) == [("product_id", 1), ("surplus fields", 1)]
    for fails in (lambda: load.clean_wide(wide).count(), lambda: load.normalise(wide).orders.count()):
        with pytest.raises(Exception, match="unusable fields"):
            fails()
    assert load.clean_wide(wide, keep_out=True).count() == 5
    with pytest.raises(snapshot.SnapshotRejected) as err:
        snapshot.load_wide(wide, os.path.join(scratch, "ragged"))
    assert err.value.violations == [("wide", "parse product_id", 1), ("wide", "parse surplus fields", 1)]


def test_staged_rows_are_read_by_column(spark, scratch):
    wide = read_wide_csv(spark, _csv(scratch, GOOD, name="staged.csv"))
    staged = load.stage(wide, os.path.join(scratch, "staged")).drop("_bad")
    t = load.normalise(staged, staged=True)
    for name, df in t.items():
        read = df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: struct<")[1].split(">")[0]
        assert len(read.split(",")) <= len(df.columns) + 3, (name, read)  # and the position
        assert sorted(rows(df)) == sorted(rows(getattr(load.normalise(wide), name)))


def test_defaults_of_a_frame_without_the_columns(spark):
    wide = spark.createDataFrame(
        [(1, 1, "d", 1, "a", 10, "p", 100, 2, 0, 9, 1.0, 1)],
        "user_id long, department_id long, department string, aisle_id long, aisle string, "
        "product_id long, product_name string, order_id long, order_number long, order_dow long, "
        "order_hour_of_day long, days_since_prior_order double, add_to_cart_order long")
    t = load.normalise(wide)
    assert rows(t.orders.select("eval_set")) == [("train",)]
    assert rows(t.order_details.select("reordered")) == [(0,)]


def test_a_cut_off_marker_is_no_publication(spark, scratch):
    root = os.path.join(scratch, "cut")
    v1 = snapshot.create_if_absent(spark, root)
    for text in ("", "{", "{}"):
        v = os.path.join(root, f"v9{len(text)}")
        os.mkdir(v)
        with open(os.path.join(v, snapshot.MARKER), "w") as f:
            f.write(text)
    assert snapshot.latest_version(spark, root) == v1


def test_sql_leaves_the_callers_views_alone(spark, scratch):
    from basketry.sources.sql import run_sql
    spark.range(3).createOrReplaceTempView("orders")
    got = run_sql(make_tables(spark, users=[(5,)]), "SELECT count(*) FROM users")
    assert rows(got) == [(1,)] and spark.table("orders").count() == 3
    assert not any(v.name == "users" for v in spark.catalog.listTables() if v.isTemporary)
    spark.catalog.dropTempView("orders")


def test_a_csv_field_is_parsed_once(spark, scratch):
    from basketry.schema import WIDE_COLUMNS
    from pyspark.sql import types as T

    known = dict(WIDE_COLUMNS)
    os.makedirs(f"{scratch}/once", exist_ok=True)
    with open(f"{scratch}/once/a.csv", "w") as f:
        f.write(",".join(known) + "\n" + ",".join("1" for _ in known) + "\n")
    cleaned = load.clean_wide(read_wide_csv(spark, f"{scratch}/once"), keep_out=True)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    longs = [c for c, t in known.items() if isinstance(t, T.LongType)]
    assert plan.count("as decimal(38,10))") == len(longs)
    assert cleaned.count() == 1
