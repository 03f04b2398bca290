"""Quoted newlines, read in parallel, against pandas."""
import os
import random

import pandas as pd
import pytest

from basketry.sources.csv import read_wide_csv

HEADER = ("order_id,product_id,add_to_cart_order,reordered,user_id,eval_set,order_number,order_dow,"
          "order_hour_of_day,days_since_prior_order,product_name,aisle_id,department_id,aisle,department")


def line(i, name):
    return f"{i},{i},1,0,1,train,2,3,4,5.0,{name},1,1,x,y"


def quoted(name):
    return '"' + name.replace('"', '""') + '"'


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def names(seed, n=400):
    r = random.Random(seed)
    return [r.choice(["plain", 'quo"te', "two\nlines", "a\r\nb", "\n\n", ',"\n",', "x" * 200 + "\n" + '"' * 3, "\n" * 90])
            + str(i) for i in range(n)]


def write(path, lines, end="\n"):
    with open(path, "w", newline="") as f:
        f.write(end.join([HEADER, *lines]) + end)


def read(spark, path):
    got = read_wide_csv(spark, path)
    assert got.filter("size(_bad) > 0").count() == 0
    return [(r.order_id, r.product_name) for r in got.orderBy("_file", "_block", "_row").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_records_as_pandas(spark, scratch, small_splits, end):
    written = names(7)
    path = os.path.join(scratch, "a b%[1]{2}.csv")
    write(path, [line(i, quoted(n) if any(c in n for c in '",\n') else n) for i, n in enumerate(written)], end)
    expected = pd.read_csv(path)
    assert list(expected.product_name) == written
    assert read(spark, scratch) == list(zip(expected.order_id, expected.product_name))


def test_files_with_and_without_newlines(spark, scratch, small_splits):
    write(os.path.join(scratch, "a.csv"), [line(i, quoted(n)) for i, n in enumerate(names(3, 60))])
    write(os.path.join(scratch, "b.csv"), [line(1000 + i, "plain") for i in range(90)])
    write(os.path.join(scratch, "c.csv"), [line(2000, quoted("all\nlines\nof one"))])
    write(os.path.join(scratch, "d.csv"), [])
    open(os.path.join(scratch, "e.csv"), "w").close()
    assert [r[0] for r in read(spark, scratch)] == [*range(60), *range(1000, 1090), 2000]


def test_a_file_that_ends_within_quotes_is_refused(spark, scratch):
    write(os.path.join(scratch, "a.csv"), [line(1, '"open'), line(2, "next")])
    with pytest.raises(ValueError, match="ends inside a quoted field"):
        read_wide_csv(spark, scratch)


def test_surplus_and_short_records_of_several_lines(spark, scratch):
    write(os.path.join(scratch, "a.csv"), [line(1, quoted("a\nb")) + ",more", "2," + quoted("\n"), line(3, "c")])
    got = {r.order_id: (r._bad, r.product_name) for r in read_wide_csv(spark, scratch).collect()}
    assert got[1] == (["surplus fields"], "a\nb") and got[3] == ([], "c")
    assert got[2][1] is None


def test_lines_are_not_dealt_where_no_field_holds_a_newline(spark, scratch):
    write(os.path.join(scratch, "a.csv"), [line(i, quoted("x, y")) for i in range(5)])
    plan = read_wide_csv(spark, scratch)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan csv" in plan


def test_lines_are_not_shuffled_to_meet(spark, scratch, small_splits):
    """Lines of a folded file are written once, compressed; what joins them needs no shuffle."""
    write(os.path.join(scratch, "a.csv"), [line(i, quoted(n)) for i, n in enumerate(names(5, 200))])
    plan = read_wide_csv(spark, scratch)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount" in plan


@pytest.mark.parametrize("buckets", [1, 4])
def test_records_over_several_splits(spark, scratch, small_splits, monkeypatch, buckets):
    monkeypatch.setattr("basketry.sources.csv.BUCKETS", buckets)
    monkeypatch.setattr("basketry.sources.csv.WRITERS", 1)
    written = ["a", "b\n" * 9_000, '"\n' * 2_500, "c", "\n" + "d" * 10_000 + "\n", "e\r\n" * 4_000 + "f", "g"]
    for file in ("x.csv", "y.csv"):
        write(os.path.join(scratch, file), [line(i, quoted(n)) for i, n in enumerate(written)])
    assert read(spark, scratch) == [*enumerate(written)] * 2
