"""Command line: create, load and query basket snapshots.

  python -m basketry create ROOT                    publish an empty snapshot if none exists
  python -m basketry load CSV ROOT [--buckets N]    load wide order-line CSV files as a new snapshot
                                                    (N: bucket orders and lines on order_id)
  python -m basketry show NAME ROOT [options]       a read operator on the newest snapshot
  python -m basketry sql FILE ROOT [options]        a SQL file over the newest snapshot
  python -m basketry edit NAME ROOT CHANGES [--out FOLDER]
                                                    a catalogue change set (Parquet, or CSV with a header),
                                                    published as the next snapshot; prints its outcomes
  python -m basketry compact ROOT                   fold what changes left in several layers

Results are printed whole, one tab-separated line a row, or written as Parquet with
--out FOLDER; --limit N asks for the first N rows.  Parameters are --param name=value,
bound as :name markers of a SQL file or as arguments of a read operator (see `show --help`).

Set the master and ``spark.checkpoint.dir`` through spark-submit / spark-defaults
on a cluster; without a master a local session is used.
"""

from __future__ import annotations

import argparse
import sys

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

from basketry.operators import catalog
from basketry.plans import catalog_views, dashboard, departments, search
from basketry.session import ensure_checkpoint_dir, local_session
from basketry.sources import snapshot
from basketry.sources.csv import read_wide_csv
from basketry.sources.sql import run_sql_file

_SEARCH = {"text": str, "department": str, "hour_from": int, "hour_to": int}


def _searched(fn):
    def run(t, hour_from: int = 0, hour_to: int = 23, **params):
        return fn(t, hours=(hour_from, hour_to), **params)
    return run


def _lookup(fn, column: str):
    def run(t, name: str):
        return fn(t, t.spark.createDataFrame([(name,)], f"{column} string"), column)
    return run


#: name -> (operator, its parameters)
READS = {
    "kpis": (dashboard.kpis, {}),
    "orders_by_hour": (dashboard.orders_by_hour, {}),
    "orders_by_dow": (dashboard.orders_by_dow, {}),
    "top_departments": (dashboard.top_departments, {}),
    "reorder_rate_by_department": (dashboard.reorder_rate_by_department, {}),
    "department_peak_hour": (departments.department_peak_hour, {}),
    "department_stats": (departments.department_stats, {}),
    "department_hour_ranking": (departments.department_hour_ranking, {}),
    "product_search": (_searched(search.product_search), _SEARCH),
    "product_search_hourly": (_searched(search.product_search_hourly), _SEARCH),
    "products": (search.products_filtered, {"department_id": int, "aisle_id": int}),
    "aisles_of_department": (search.aisles_of_department, {"department_id": int}),
    "list_aisles": (catalog_views.list_aisles, {}),
    "list_departments": (catalog_views.list_departments, {}),
    "lookup_aisles": (_lookup(catalog_views.lookup_aisles, "aisle"), {"name": str}),
    "lookup_departments": (_lookup(catalog_views.lookup_departments, "department"), {"name": str}),
    "refcount_aisles": (catalog_views.refcount_aisles, {}),
    "refcount_departments": (catalog_views.refcount_departments, {}),
}


#: name -> (columns of the change set, operator)
EDITS = {
    "insert_aisles": ("seq long, name string", lambda t, c: catalog.insert_names(t.aisles, "aisle_id", "aisle", c)),
    "insert_departments": ("seq long, name string", lambda t, c: catalog.insert_names(
        t.departments, "department_id", "department", c)),
    "rename_aisles": ("seq long, id long, name string", lambda t, c: catalog.rename_names(
        t.aisles, "aisle_id", "aisle", c)),
    "rename_departments": ("seq long, id long, name string", lambda t, c: catalog.rename_names(
        t.departments, "department_id", "department", c)),
    "delete_aisles": ("seq long, id long", lambda t, c: catalog.guarded_delete(t.aisles, "aisle_id", t.products, c)),
    "delete_departments": ("seq long, id long", lambda t, c: catalog.guarded_delete(
        t.departments, "department_id", t.products, c)),
    "insert_products": ("seq long, product_name string, aisle_id long, department_id long", catalog.insert_products),
    "update_products": ("seq long, product_id long, product_name string, aisle_id long, department_id long",
                        catalog.update_products),
    "delete_products": ("product_id long", lambda t, c: catalog.product_removal(c)),
}


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        if not SparkConf().contains("spark.master"):
            return local_session()
        spark = SparkSession.builder.appName("basketry").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="basketry", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("create").add_argument("root")
    load = sub.add_parser("load")
    load.add_argument("csv")
    load.add_argument("root")
    load.add_argument("--buckets", type=int)
    edit = sub.add_parser("edit", epilog="change sets:\n" + "\n".join(f"  {n}: {c}" for n, (c, _) in EDITS.items()),
                          formatter_class=argparse.RawDescriptionHelpFormatter)
    edit.add_argument("name", choices=sorted(EDITS), metavar="name")
    edit.add_argument("root")
    edit.add_argument("changes")
    edit.add_argument("--out", metavar="FOLDER")
    sub.add_parser("compact").add_argument("root")
    named = "\n".join(f"  {n}: {', '.join(ps) or '-'}" for n, (_, ps) in READS.items())
    for command, what in (("show", "name"), ("sql", "file")):
        c = sub.add_parser(command, epilog=f"operators and parameters:\n{named}" * (command == "show"),
                           formatter_class=argparse.RawDescriptionHelpFormatter)
        c.add_argument(what, **({"choices": sorted(READS), "metavar": "name"} if what == "name" else {}))
        c.add_argument("root")
        c.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
        c.add_argument("--limit", type=int)
        c.add_argument("--out", metavar="FOLDER")
    return p


def _put(df: DataFrame, limit: int | None, out: str | None) -> None:
    df = df if limit is None else df.limit(limit)
    if out:
        df.write.parquet(out)
        return
    print("\t".join(df.columns))
    for row in df.toLocalIterator():  # a partition at a time
        print("\t".join("NULL" if v is None else str(v) for v in row))


def _edit(spark: SparkSession, args) -> int:
    columns, operator = EDITS[args.name]
    base = snapshot.latest_version(spark, args.root)
    tables = snapshot.read_snapshot(spark, base)
    asked = (spark.read.schema(columns).option("header", True).csv(args.changes) if args.changes.endswith(".csv")
             else spark.read.parquet(args.changes))
    result = operator(tables, asked)
    version = snapshot.publish_change(spark, args.root, result if isinstance(result, list) else [result.step], base)
    print(version, file=sys.stderr)
    if not isinstance(result, list):
        _put(result.outcomes.orderBy("seq"), None, args.out)
    return 0


def main(argv: list[str]) -> int:
    args = _parser().parse_args(argv)
    spark = _session()
    if args.command == "create":
        print(snapshot.create_if_absent(spark, args.root))
        return 0
    if args.command == "load":
        print(snapshot.load_wide(read_wide_csv(spark, args.csv), args.root,
                                 order_buckets_n=args.buckets))
        return 0
    if args.command == "compact":
        print(snapshot.compact(spark, args.root))
        return 0
    if args.command == "edit":
        return _edit(spark, args)
    params = dict(x.split("=", 1) for x in args.param)
    tables = snapshot.read_snapshot(spark, args.root)
    if args.command == "sql":
        _put(run_sql_file(tables, args.file, params), args.limit, args.out)
    else:
        fn, types = READS[args.name]
        if unknown := params.keys() - types.keys():
            raise SystemExit(f"{args.name} takes {sorted(types) or 'no parameters'}, not {sorted(unknown)}")
        _put(fn(tables, **{k: types[k](v) for k, v in params.items()}), args.limit, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
