"""Named queries over the generated inputs: ``name -> f(spark, sf_dir) -> DataFrame``.

Each entry maps the inputs in ``sf_dir`` to the six basket tables
(`basketry.sources.fixture`) and runs one operator over the whole tables.
`basketry.oracle.SQL` holds the matching DuckDB query for each name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import audit as audit_ops
from basketry.operators import catalog, changes, load
from basketry.plans import catalog_views, cells, dashboard, departments, search
from basketry.session import scratch_path, session_key
from basketry.sources import snapshot
from basketry.sources.csv import read_wide_csv
from basketry.sources.fixture import derived, fixture_tables, fixture_wide, publish_fixture
from basketry.sources.sql import run_sql_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _on_tables(name: str, fn, **kwargs) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(fixture_tables(spark, sf_dir), **kwargs)


_on_tables("department_peak_hour", departments.department_peak_hour)
_on_tables("department_stats", departments.department_stats)
_on_tables("department_hour_ranking", departments.department_hour_ranking)
_on_tables("kpis", dashboard.kpis)
_on_tables("orders_by_hour", dashboard.orders_by_hour)
_on_tables("orders_by_dow", dashboard.orders_by_dow)
_on_tables("top_departments", dashboard.top_departments)
_on_tables("reorder_rate_by_department", dashboard.reorder_rate_by_department)

# ---- search and catalogue reads ----------------------------------------------
def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


_on_tables("product_search", search.product_search, text="GEAR")
_on_tables("product_search_all", search.product_search, text="")
_on_tables("product_search_department", search.product_search, text="o", department="Brand#3")
_on_tables("product_search_band", search.product_search, text="", hours=(6, 17))
_on_tables("product_search_hourly", search.product_search_hourly, text="", hours=(6, 17))
_on_tables("product_search_banded_sql", search.product_search_banded_sql, text="o", hours=(6, 17))
_on_tables("aisles_of_department", search.aisles_of_department)
_on_tables("products_filtered", search.products_filtered)
_on_tables("products_filtered_department_aisle", search.products_filtered,
           department_id=3, aisle_id=2)
_on_tables("product_search_wildcards", search.product_search, text="_e%r")
_on_tables("aisles_of_one_department", search.aisles_of_department, department_id=3)
_on_tables("list_aisles", catalog_views.list_aisles)
_on_tables("list_departments", catalog_views.list_departments)
_on_tables("refcount_aisles", catalog_views.refcount_aisles)
_on_tables("refcount_departments", catalog_views.refcount_departments)


def _lookup_aisles(spark, sf_dir):
    part = _part(spark, sf_dir)
    names = part.select(F.col("p_type").alias("n")).unionByName(part.select(F.col("p_name").alias("n")))
    return catalog_views.lookup_aisles(fixture_tables(spark, sf_dir), names, "n")


def _lookup_departments(spark, sf_dir):
    part = _part(spark, sf_dir)
    names = part.select(F.col("p_brand").alias("n")).unionByName(part.select(F.col("p_name").alias("n")))
    return catalog_views.lookup_departments(fixture_tables(spark, sf_dir), names, "n")


QUERIES["lookup_aisles"] = _lookup_aisles
QUERIES["lookup_departments"] = _lookup_departments

# ---- load path: clean, normalise, audit; SQL text ------------------------------
def _normalised(table: str) -> Query:
    return lambda spark, sf_dir: getattr(load.normalise(fixture_wide(spark, sf_dir)), table)


QUERIES["clean_wide"] = lambda spark, sf_dir: load.clean_wide(fixture_wide(spark, sf_dir))
for _t in ["users", "departments", "aisles", "products", "orders", "order_details"]:
    QUERIES[f"normalised_{_t}"] = _normalised(_t)
QUERIES["audit_fixture"] = lambda spark, sf_dir: audit_ops.audit(fixture_tables(spark, sf_dir))


def _audit_raw_lines(spark, sf_dir):
    """Audit with order lines taken straight from lineitem: repeated
    (order, part) pairs break the key, lines of first orders the FK."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    raw = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                    F.col("l_linenumber").cast("bigint").alias("add_to_cart_order"),
                    F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("bigint")
                    .alias("reordered"))
    return audit_ops.audit(fixture_tables(spark, sf_dir).with_(order_details=raw))


QUERIES["audit_raw_lines"] = _audit_raw_lines
_on_tables("department_peak_hour_sql", run_sql_file, path="department_peak_hour.sql")
_on_tables("product_search_sql", search.product_search_sql, text="GEAR")
_on_tables("product_search_sql_department", search.product_search_sql, text="o",
           department="Brand#3")

# ---- catalogue change sets -------------------------------------------------------
def _part_ids(spark, sf_dir):
    """part rows with the mapped aisle / department ids (the change-set source)."""
    t = fixture_tables(spark, sf_dir)
    part = _part(spark, sf_dir).select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return t, (part.join(t.aisles, part.p_type == t.aisles.aisle)
               .join(t.departments, part.p_brand == t.departments.department))


def _aisle_inserts(spark, sf_dir):
    part = _part(spark, sf_dir)
    size = F.col("p_size")
    names = part.select((F.col("p_partkey") * 2).alias("seq"),
                        F.when(size <= 2, F.lit(" "))
                        .when(size <= 5, F.concat(F.lit("  "), "p_name", F.lit(" ")))
                        .otherwise(F.col("p_name")).alias("name"))
    types = part.select((F.col("p_partkey") * 2 + 1).alias("seq"), F.col("p_type").alias("name"))
    return catalog.insert_names(fixture_tables(spark, sf_dir).aisles, "aisle_id", "aisle",
                                names.unionByName(types))


def _department_inserts(spark, sf_dir):
    part = _part(spark, sf_dir)
    names = part.select((F.col("p_partkey") * 2).alias("seq"), F.upper("p_name").alias("name"))
    brands = part.select((F.col("p_partkey") * 2 + 1).alias("seq"), F.col("p_brand").alias("name"))
    return catalog.insert_names(fixture_tables(spark, sf_dir).departments, "department_id",
                                "department", names.unionByName(brands))


def _aisle_renames(spark, sf_dir):
    t, p = _part_ids(spark, sf_dir)
    size = F.col("p_size")
    req = p.select(F.col("p_partkey").alias("seq"),
                   F.when(size > 47, F.col("aisle_id") + 100).otherwise(F.col("aisle_id")).alias("id"),
                   F.when(size <= 2, F.lit("")).when(size == 3, F.lit("SMALL"))
                   .otherwise(F.upper("p_name")).alias("name"))
    return catalog.rename_names(t.aisles, "aisle_id", "aisle", req)


def _department_renames(spark, sf_dir):
    t, p = _part_ids(spark, sf_dir)
    req = p.select(F.col("p_partkey").alias("seq"), F.col("department_id").alias("id"),
                   F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_type")).alias("name"))
    return catalog.rename_names(t.departments, "department_id", "department", req)


def _aisle_deletes(spark, sf_dir):
    t, p = _part_ids(spark, sf_dir)
    req = p.select(F.col("p_partkey").alias("seq"),
                   F.when(F.col("p_size") > 47, F.col("aisle_id") + 100)
                   .otherwise(F.col("aisle_id")).alias("id"))
    return catalog.guarded_delete(t.aisles, "aisle_id", t.products, req)


def _department_deletes_after_insert(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    grown = _department_inserts(spark, sf_dir).table
    req = grown.select(F.col("department_id").alias("seq"), F.col("department_id").alias("id"))
    return catalog.guarded_delete(grown, "department_id", t.products, req)


def _product_inserts(spark, sf_dir):
    t, p = _part_ids(spark, sf_dir)
    size = F.col("p_size")
    req = p.select(F.col("p_partkey").alias("seq"),
                   F.when(size <= 1, F.lit(" ")).otherwise(F.concat("p_name", F.lit(" bio")))
                   .alias("product_name"),
                   F.when(size == 50, F.lit(999)).otherwise(F.col("aisle_id")).alias("aisle_id"),
                   F.when(size == 49, F.lit(999)).otherwise(F.col("department_id"))
                   .alias("department_id"))
    return catalog.insert_products(t, req)


def _product_updates(spark, sf_dir):
    t, p = _part_ids(spark, sf_dir)
    size = F.col("p_size")
    pid = F.when(size == 48, F.col("p_partkey") + 1000000).otherwise(F.col("p_partkey"))
    dept = F.when(size == 50, F.lit(999)).otherwise(F.col("department_id"))
    first = p.select((F.col("p_partkey") * 2).alias("seq"), pid.alias("product_id"),
                     F.upper("p_name").alias("product_name"), "aisle_id", dept.alias("department_id"))
    second = p.select((F.col("p_partkey") * 2 + 1).alias("seq"), pid.alias("product_id"),
                      F.when(size <= 1, F.lit("")).otherwise(F.concat("p_name", F.lit(" v2")))
                      .alias("product_name"), "aisle_id", dept.alias("department_id"))
    return catalog.update_products(t, first.unionByName(second))


def _small_parts(spark, sf_dir):
    return _part(spark, sf_dir).filter(F.col("p_size") <= 5).select(
        F.col("p_partkey").alias("product_id"))


def _building_users(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))


QUERIES["high_water_mark_products"] = lambda spark, d: catalog.high_water_mark(
    fixture_tables(spark, d).products, "product_id")
QUERIES["insert_aisles"] = lambda spark, d: _aisle_inserts(spark, d).outcomes
QUERIES["insert_aisles_table"] = lambda spark, d: _aisle_inserts(spark, d).table
QUERIES["insert_departments"] = lambda spark, d: _department_inserts(spark, d).outcomes
QUERIES["rename_aisles"] = lambda spark, d: _aisle_renames(spark, d).outcomes
QUERIES["rename_aisles_table"] = lambda spark, d: _aisle_renames(spark, d).table
def _contested_department_renames(spark, sf_dir):
    """All departments after the same few names: most requests are refused."""
    req = _part(spark, sf_dir).select(F.col("p_partkey").alias("seq"),
                                      (F.col("p_size") % 25 + 1).cast("bigint").alias("id"),
                                      F.col("p_type").alias("name"))
    return catalog.rename_names(fixture_tables(spark, sf_dir).departments, "department_id",
                                "department", req)


QUERIES["rename_departments"] = lambda spark, d: _contested_department_renames(spark, d).outcomes
QUERIES["rename_departments_table"] = lambda spark, d: _department_renames(spark, d).table
QUERIES["delete_aisles"] = lambda spark, d: _aisle_deletes(spark, d).outcomes
QUERIES["delete_departments"] = lambda spark, d: _department_deletes_after_insert(spark, d).outcomes
QUERIES["insert_products"] = lambda spark, d: _product_inserts(spark, d).outcomes
QUERIES["insert_products_table"] = lambda spark, d: _product_inserts(spark, d).table
QUERIES["update_products"] = lambda spark, d: _product_updates(spark, d).outcomes
QUERIES["update_products_table"] = lambda spark, d: _product_updates(spark, d).table
QUERIES["delete_product_lines"] = lambda spark, d: catalog.delete_product_lines(
    fixture_tables(spark, d).order_details, _small_parts(spark, d))
QUERIES["delete_products"] = lambda spark, d: catalog.delete_products(
    fixture_tables(spark, d), _small_parts(spark, d)).products
QUERIES["cascade_delete_users_orders"] = lambda spark, d: catalog.cascade_delete(
    fixture_tables(spark, d), "users", _building_users(spark, d)).orders
QUERIES["cascade_delete_users_lines"] = lambda spark, d: catalog.cascade_delete(
    fixture_tables(spark, d), "users", _building_users(spark, d)).order_details
QUERIES["cascade_delete_aisles_lines"] = lambda spark, d: catalog.cascade_delete(
    fixture_tables(spark, d), "aisles",
    fixture_tables(spark, d).aisles.filter(F.col("aisle").isin("SMALL", "PROMO"))
    .select("aisle_id")).order_details

QUERIES["insert_departments_table"] = lambda spark, d: _department_inserts(spark, d).table
QUERIES["delete_aisles_table"] = lambda spark, d: _aisle_deletes_after_insert(spark, d).table
QUERIES["delete_departments_table"] = lambda spark, d: _department_deletes_after_insert(spark, d).table


def _aisle_deletes_after_insert(spark, sf_dir):
    """Every aisle after the inserts is asked to go; only the new ones may."""
    grown = _aisle_inserts(spark, sf_dir).table
    req = grown.select(F.col("aisle_id").alias("seq"), F.col("aisle_id").alias("id"))
    return catalog.guarded_delete(grown, "aisle_id", fixture_tables(spark, sf_dir).products, req)


def _cascade(table: str, keys, result: str) -> Query:
    return lambda spark, d: getattr(
        catalog.cascade_delete(t := fixture_tables(spark, d), table, keys(spark, d, t)), result)


QUERIES["cascade_delete_departments_lines"] = _cascade(
    "departments", lambda spark, d, t: t.departments.filter("department_id % 3 = 1")
    .select("department_id"), "order_details")
QUERIES["cascade_delete_orders_lines"] = _cascade(
    "orders", lambda spark, d, t: t.orders.filter("order_dow = 0").select("order_id"), "order_details")
QUERIES["cascade_delete_products_lines"] = _cascade(
    "products", lambda spark, d, t: _small_parts(spark, d), "order_details")

# ---- catalogue states that the plain mapping does not have ---------------------
def _grown(spark: SparkSession, sf_dir: str):
    """The tables after inserting aisles and departments no product uses, with
    the lines of small parts gone, so their products are unsold."""
    t = fixture_tables(spark, sf_dir)
    return t.with_(aisles=_aisle_inserts(spark, sf_dir).table,
                   departments=_department_inserts(spark, sf_dir).table,
                   order_details=catalog.delete_product_lines(t.order_details,
                                                              _small_parts(spark, sf_dir)))


QUERIES["refcount_aisles_unused"] = lambda spark, d: catalog_views.refcount_aisles(_grown(spark, d))
QUERIES["refcount_departments_unused"] = lambda spark, d: catalog_views.refcount_departments(
    _grown(spark, d))
QUERIES["product_search_unsold"] = lambda spark, d: search.product_search(_grown(spark, d), "")
QUERIES["product_search_banded_orders"] = lambda spark, d: search.product_search_banded(
    _grown(spark, d), "", hours=(6, 17))
QUERIES["product_search_escaped"] = lambda spark, d: search.product_search(
    (t := fixture_tables(spark, d)).with_(products=t.products.withColumn(
        "product_name", F.concat("product_name", F.when(F.col("product_id") % 2 == 0, "_50%")
                                 .otherwise(" 50x")))), "\\_50\\%")
QUERIES["orders_by_dow_unknown"] = lambda spark, d: dashboard.orders_by_dow(
    (t := fixture_tables(spark, d)).with_(orders=t.orders.withColumn(
        "order_dow", F.when(F.col("order_id") % 10 == 0, F.col("order_dow") + 5)
        .otherwise(F.col("order_dow")))))


def _renamed_wide(spark, sf_dir):
    """Wide rows where every third product calls its aisle and department by
    another name: the same ids under two names.  Without file positions the
    smallest name is kept."""
    third = F.col("product_id") % 3 == 0
    return fixture_wide(spark, sf_dir).withColumns({
        c: F.when(third, F.concat(F.lit("~"), c)).otherwise(F.col(c)) for c in ("aisle", "department")})


for _t in ["departments", "aisles"]:
    QUERIES[f"normalised_{_t}_two_names"] = (
        lambda t: lambda spark, d: getattr(load.normalise(_renamed_wide(spark, d)), t))(_t)
QUERIES["normalised_orders_defaults"] = lambda spark, d: load.normalise(
    fixture_wide(spark, d).drop("eval_set", "reordered")).orders
QUERIES["normalised_order_details_defaults"] = lambda spark, d: load.normalise(
    fixture_wide(spark, d).drop("eval_set", "reordered")).order_details


def _dirty_tables(spark, sf_dir):
    """Every constraint broken somewhere, by rules over whole tables."""
    t = fixture_tables(spark, sf_dir)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def broken(column, when, value):
        return F.when(F.expr(when), F.expr(value)).otherwise(F.col(column)).alias(column)

    def names(df, key, name):
        more = [df.filter(f"{key} = 1"),  # the key and the name twice
                df.filter(f"{key} = 2").select((F.col(key) + 1000).alias(key),
                                               F.lit(None).cast("string").alias(name)),
                df.filter(f"{key} = 3").select((F.col(key) + 2000).alias(key),
                                               F.expr("repeat('x', 256)").alias(name)),
                df.filter(f"{key} = 3").select(F.lit(None).cast("bigint").alias(key),
                                               F.lit("no id").alias(name))]
        for m in more:
            df = df.unionByName(m)
        return df

    return t.with_(
        users=t.users.unionByName(t.users.filter("user_id % 50 = 0"))
        .unionByName(t.users.filter("user_id % 49 = 0").select(F.lit(None).cast("bigint").alias("user_id"))),
        departments=names(t.departments, "department_id", "department"),
        aisles=names(t.aisles, "aisle_id", "aisle"),
        products=t.products.select(
            broken("product_id", "product_id % 53 = 0", "product_id + 1"),
            broken("product_name", "product_id % 47 = 0", "if(product_id % 2 = 0, NULL, repeat('y', 300))"),
            broken("aisle_id", "product_id % 43 = 0", "if(product_id % 2 = 0, NULL, 999)"),
            broken("department_id", "product_id % 41 = 0", "if(product_id % 2 = 0, NULL, 999)")),
        orders=t.orders.select(
            broken("order_id", "order_id % 101 = 0", "NULL"),
            broken("user_id", "order_id % 71 = 5", "if(order_id % 2 = 0, NULL, user_id + 1000000000)"),
            broken("eval_set", "order_id % 73 = 4", "repeat('e', 51)"),
            broken("order_number", "order_id % 97 = 1", "0"),
            broken("order_dow", "order_id % 89 = 1", "7"),
            broken("order_hour_of_day", "order_id % 83 = 2", "-1"),
            broken("days_since_prior_order", "order_id % 79 = 3", "-0.5D")),
        order_details=li.select(
            F.expr("if(l_orderkey % 61 = 0, NULL, l_orderkey)").alias("order_id"),
            F.expr("if(l_partkey % 59 = 0, NULL, l_partkey + if(l_partkey % 37 = 0, 1000000000, 0))")
            .alias("product_id"),
            F.expr("CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_orderkey % 29 = 0 THEN 0L "
                   "ELSE CAST(l_linenumber AS BIGINT) END").alias("add_to_cart_order"),
            F.expr("CASE WHEN l_returnflag = 'R' THEN 1L WHEN l_orderkey % 23 = 0 THEN 2L ELSE 0L END")
            .alias("reordered")))


QUERIES["audit_dirty"] = lambda spark, d: audit_ops.audit(_dirty_tables(spark, d))

# ---- snapshots: schema, publication, reading back --------------------------------
_SNAPSHOTS: dict = {}


def _snapshot(spark: SparkSession, sf_dir: str):
    """The tables of ``sf_dir`` published as a snapshot, once per session and input."""
    key = (session_key(spark), sf_dir, id(derived(spark, sf_dir)))
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = scratch_path(spark, "snapshots")
        publish_fixture(spark, sf_dir, _SNAPSHOTS[key])
    return snapshot.read_snapshot(spark, _SNAPSHOTS[key])


for _t in ["users", "departments", "aisles", "products", "orders", "order_details"]:
    QUERIES[f"snapshot_roundtrip_{_t}"] = (
        lambda t: lambda spark, d: getattr(_snapshot(spark, d), t))(_t)


def _edited(spark: SparkSession, sf_dir: str):
    """The snapshot after publishing, one after the other: new aisles, renamed
    departments, updated products, the removal of small products with their lines
    and of some users with all that is theirs."""
    key = (session_key(spark), sf_dir, id(derived(spark, sf_dir)), "edited")
    if key not in _SNAPSHOTS:
        root = scratch_path(spark, "snapshots")
        publish_fixture(spark, sf_dir, root)
        snapshot.maintain_cells(spark, root)
        snapshot.index_names(spark, root)
        for change in (lambda t: [_aisle_inserts(spark, sf_dir).step],
                       lambda t: [_department_renames(spark, sf_dir).step],
                       lambda t: [_product_updates(spark, sf_dir).step],
                       lambda t: changes.cascade_steps(t, "users", _building_users(spark, sf_dir))
                       + catalog.product_removal(_small_parts(spark, sf_dir))):
            snapshot.publish_change(spark, root, change(snapshot.read_snapshot(spark, root)))
        _SNAPSHOTS[key] = root
    return snapshot.read_snapshot(spark, _SNAPSHOTS[key])


def _compacted(spark: SparkSession, sf_dir: str):
    _edited(spark, sf_dir)
    root = _SNAPSHOTS[(session_key(spark), sf_dir, id(derived(spark, sf_dir)), "edited")]
    version = snapshot.compact(spark, root)
    return snapshot.read_snapshot(spark, version)


for _t in ["aisles", "departments", "products"]:
    QUERIES[f"publish_change_{_t}"] = (lambda t: lambda spark, d: getattr(_edited(spark, d), t))(_t)
for _t in ["users", "orders", "order_details"]:
    QUERIES[f"snapshot_after_delete_{_t}"] = (lambda t: lambda spark, d: getattr(_edited(spark, d), t))(_t)
QUERIES["snapshot_compacted_order_details"] = lambda spark, d: _compacted(spark, d).order_details
QUERIES["department_peak_hour_after_changes"] = lambda spark, d: departments.department_peak_hour(_edited(spark, d))


def _cells(spark: SparkSession, sf_dir: str):
    """The cells kept through all those changes, and the departments by then."""
    t = _edited(spark, sf_dir)
    root = _SNAPSHOTS[(session_key(spark), sf_dir, id(derived(spark, sf_dir)), "edited")]
    return snapshot.read_cells(spark, root), t.departments


def _indexed_search(text: str) -> Query:
    """Over the changed snapshot, with the index kept through the changes."""
    def run(spark, sf_dir):
        t = _edited(spark, sf_dir)
        root = _SNAPSHOTS[(session_key(spark), sf_dir, id(derived(spark, sf_dir)), "edited")]
        return search.product_search(t, text, index=snapshot.read_names(spark, root))
    return run


QUERIES["product_search_indexed"] = _indexed_search("GEAR")
QUERIES["product_search_indexed_updated"] = _indexed_search("r V2")
QUERIES["product_search_indexed_wildcards"] = _indexed_search("gea_ v%")
QUERIES["maintained_orders_by_hour"] = lambda spark, d: cells.orders_by_hour(_cells(spark, d)[0])
QUERIES["maintained_orders_by_dow"] = lambda spark, d: cells.orders_by_dow(_cells(spark, d)[0])
QUERIES["maintained_top_departments"] = lambda spark, d: cells.top_departments(*_cells(spark, d))
QUERIES["maintained_reorder_rate"] = lambda spark, d: cells.reorder_rate_by_department(*_cells(spark, d))
QUERIES["maintained_peak_hour"] = lambda spark, d: cells.department_peak_hour(*_cells(spark, d))


def _bad_steps(spark, sf_dir):
    """A change set that breaks rules of every kind over a clean snapshot."""
    t = _snapshot(spark, sf_dir)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    aisles = t.aisles.filter("aisle_id <= 4").select(
        F.expr("CASE aisle_id WHEN 1 THEN 1 WHEN 4 THEN NULL ELSE aisle_id + 9000 END").alias("aisle_id"),
        F.expr("CASE aisle_id WHEN 2 THEN NULL WHEN 3 THEN aisle WHEN 4 THEN repeat('x', 256) ELSE 'other' END")
        .alias("aisle"))
    lines = li.filter("l_orderkey % 3 = 0").select(
        F.expr("l_orderkey + if(l_orderkey % 5 = 0, 1000000000, 0)").alias("order_id"),
        F.expr("if(l_partkey % 7 = 0, NULL, l_partkey)").alias("product_id"),
        F.expr("CAST(if(l_partkey % 11 = 0, 0, l_linenumber) AS BIGINT)").alias("add_to_cart_order"),
        F.expr("CAST(if(l_partkey % 13 = 0, 2, 0) AS BIGINT)").alias("reordered"))
    moved = t.products.filter("product_id % 17 = 0").select(
        "product_id", "product_name", F.expr("aisle_id + 500").alias("aisle_id"), "department_id")
    return t, [changes.Step("aisles", rows=aisles), changes.Step("order_details", rows=lines),
               changes.Step("products", rows=moved, replace=True),
               changes.Step("products", gone=t.products.filter("product_id % 19 = 0").select("product_id")),
               changes.Step("departments", gone=t.departments.filter("department_id % 6 = 5").select("department_id")),
               changes.Step("users", gone=t.users.filter("user_id % 23 = 0").select("user_id"))]


QUERIES["audit_delta_dirty"] = lambda spark, d: changes.audit_delta(*_bad_steps(spark, d))
QUERIES["audit_delta_cascade"] = lambda spark, d: changes.audit_delta(
    t := _snapshot(spark, d), changes.cascade_steps(t, "aisles", t.aisles.filter("aisle_id % 2 = 0").select("aisle_id"))
    + changes.cascade_steps(t, "users", _building_users(spark, d)))


def _schema_created(spark, sf_dir):
    """The tables' columns after creating an empty snapshot and loading the
    wide rows over it, with each table's rows."""
    root = scratch_path(spark, "created")
    snapshot.create_if_absent(spark, root)
    snapshot.load_wide(fixture_wide(spark, sf_dir), root)
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(
        F.lit(name).alias("table"), F.lit(" ".join(df.columns)).alias("columns"), "rows")
        for name, df in snapshot.read_snapshot(spark, root).items()]
    return reduce(DataFrame.unionByName, parts)


QUERIES["schema_created"] = _schema_created

# ---- the CSV source end to end -------------------------------------------------
_CSV_COPIES: dict = {}


def _csv_copy(spark: SparkSession, sf_dir: str, kind: str, write) -> str:
    """A folder that ``write`` fills once per session and input (under the
    checkpoint folder, shared on a cluster)."""
    key = (session_key(spark), sf_dir, id(derived(spark, sf_dir)), kind)
    if key not in _CSV_COPIES:
        path = scratch_path(spark, kind)
        write(path)
        _CSV_COPIES[key] = path
    return _CSV_COPIES[key]


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _wide_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapped wide frame as RFC-4180 CSV, read back by the CSV source."""
    return read_wide_csv(spark, _csv_copy(
        spark, sf_dir, "wide-csv", lambda path: _write_csv(fixture_wide(spark, sf_dir), path)))


def _dirty_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide rows as three folders of CSV: `a`, `b` with the columns in
    reverse order, `c` with lines that have a field too many.  Numbers that do
    not parse and missing-value tokens stand in all of them."""
    def write(path):
        k = (F.col("order_id") * 7 + F.col("product_id")) % 100
        wide = fixture_wide(spark, sf_dir).withColumn("k", k)
        text = wide.select("k", *[F.col(c).cast("string").alias(c) for c in wide.columns if c != "k"])
        text = text.withColumns({
            "order_number": F.expr("CASE WHEN k IN (10, 35, 92) THEN 'x7' WHEN k = 60 THEN '2.5' ELSE order_number END"),
            "reordered": F.expr("CASE WHEN k = 20 THEN '1.50' WHEN k = 21 THEN '1.0' ELSE reordered END"),
            "product_name": F.expr("CASE WHEN k IN (30, 35) THEN 'NA' WHEN k = 70 THEN '' ELSE product_name END"),
            "days_since_prior_order": F.expr("CASE WHEN k = 40 THEN 'soon' WHEN k = 75 THEN 'n/a' "
                                             "ELSE days_since_prior_order END")})
        cols = [c for c in text.columns if c != "k"]
        _write_csv(text.filter("k < 50").select(cols), f"{path}/a")
        _write_csv(text.filter("k BETWEEN 50 AND 89").select(cols[::-1]), f"{path}/b")
        # whole lines under one column named by the header: the separator of
        # this writer never occurs, so commas and quotes stay as they are
        quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
                  for c in cols]
        line = F.concat(F.concat_ws(",", *quoted), F.when(F.col("k") == 95, ",more").otherwise(""))
        (text.filter("k >= 90").select(line.alias(",".join(cols))).write.option("header", True)
         .option("sep", "\u0001").option("quote", "\u0002").option("escapeQuotes", False).csv(f"{path}/c"))

    return read_wide_csv(spark, _csv_copy(spark, sf_dir, "dirty-csv", write) + "/*")


def _multiline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide rows as two folders of CSV with every field in quotes: in `a`
    names hold newlines and quotes beside them, in `b` no field does."""
    def write(path):
        product = F.col("product_id")
        name = (F.when(product % 3 == 0, F.replace("product_name", F.lit(" "), F.lit("\n")))
                .when(product % 5 == 0, F.concat(F.lit('"\n'), "product_name", F.lit('\n\n,"'))).otherwise(
            F.col("product_name")))
        wide = fixture_wide(spark, sf_dir).withColumn("product_name", name)
        folded = (product % 3 == 0) | (product % 5 == 0) | (product % 2 == 0)
        for folder, rows in (("a", folded), ("b", ~folded)):
            (wide.filter(rows).write.option("header", True).option("quoteAll", True).option("escape", '"')
             .csv(f"{path}/{folder}"))

    return read_wide_csv(spark, _csv_copy(spark, sf_dir, "multiline-csv", write) + "/*")


QUERIES["csv_multiline_clean_wide"] = lambda spark, d: load.clean_wide(_multiline_csv(spark, d))
QUERIES["csv_multiline_products"] = lambda spark, d: load.normalise(_multiline_csv(spark, d)).products
QUERIES["csv_clean_wide"] = lambda spark, d: load.clean_wide(_wide_from_csv(spark, d))
for _t in ["departments", "products", "orders", "order_details"]:
    QUERIES[f"csv_normalised_{_t}"] = (
        lambda t: lambda spark, d: getattr(load.normalise(_wide_from_csv(spark, d)), t))(_t)
QUERIES["csv_dirty_clean_wide"] = lambda spark, d: load.clean_wide(_dirty_csv(spark, d), keep_out=True)
QUERIES["csv_dirty_orders"] = lambda spark, d: load.normalise(_dirty_csv(spark, d), keep_out=True).orders
QUERIES["csv_dirty_rejects"] = lambda spark, d: load.rejects(_dirty_csv(spark, d)).groupBy(
    F.element_at(F.split("file", "/"), -2).alias("folder"), "rule").agg(
    F.sum("violations").alias("violations"))
