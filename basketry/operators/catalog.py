"""Catalogue maintenance as bulk change sets.

The reference edits one row per click.  Here a change set is a DataFrame of
requests with a unique ``seq`` (the order in which they would have been
clicked); each operator returns the new table version and an ``outcomes``
frame with one row per request: ``(seq, status, <id>, detail)``.

Rules (the reference's, applied to a batch):

* names are stripped as Python's ``str.strip`` does; blank names are refused,
  names over 255 characters too (the column is VARCHAR(255));
* aisle / department names are UNIQUE: inserting an existing name reports the
  existing id; within a batch the lowest ``seq`` wins and later copies report
  the winner's id; new ids continue from ``COALESCE(MAX(id), 1) + 1`` in
  ``seq`` order (so an empty table starts at 2, as the reference's sequence
  sync does);
* renames are judged one after the other in ``seq`` order, as clicks are: a
  rename onto a name that another id holds at that time is refused and changes
  nothing; of an id's granted renames the last stays, earlier ones are
  ``superseded``; an unknown id is a no-op (0 rows updated);
* product updates: the last valid request per product wins, earlier ones are
  ``superseded``; an unknown product is a no-op;
* guarded deletes refuse ids still referenced by products (reporting the
  count); product deletes also remove the product's order lines; deletes
  along the foreign keys cascade, as ON DELETE CASCADE does.

Everything is joins, partial aggregates and anti/semi joins; the only
ordered numbering is `basketry.functions.ids.ids_by_rank`, and renames that
meet over a name are settled in rounds (`basketry.operators.settle`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.ids import ids_by_rank
from basketry.functions.text import strip
from basketry.operators.changes import Step
from basketry.operators.settle import refused_renames
from basketry.schema import MAX_LENGTH, PRIMARY_KEYS, TABLE_ORDER, children_of
from basketry.tables import Tables

NAME_LIMIT = 255


@dataclass(frozen=True)
class ChangeResult:
    table: DataFrame
    outcomes: DataFrame  # (seq, status, id, detail)
    step: Step  # the table's change as rows and keys


def _table_of(id_col: str) -> str:
    return next(name for name, key in PRIMARY_KEYS.items() if key == [id_col])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _requests(changes: DataFrame) -> DataFrame:
    """The change set; a ``seq`` that occurs twice is refused, as outcomes are
    told apart by it."""
    again = changes.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seq").head(1)
    if again:
        raise ValueError(f"repeated seq in a change set: {again[0][0]}")
    return changes


def high_water_mark(df: DataFrame, id_col: str) -> DataFrame:
    """One row, ``COALESCE(MAX(id), 1)``."""
    return df.agg(F.coalesce(F.max(id_col), F.lit(1)).cast("bigint").alias("high_water_mark"))


def insert_names(dim: DataFrame, id_col: str, name_col: str, changes: DataFrame,
                 changes_name_col: str = "name") -> ChangeResult:
    """Insert unique names (aisles, departments) and allocate their ids.

    Two passes over the change set: one finds the first request of every new
    name (a partial aggregate) and numbers those; the other classifies the
    requests: blank and over-long names by themselves, the others with two
    LEFT joins (existing names, numbered new names).
    """
    c = _requests(changes).select("seq", strip(F.col(changes_name_col)).alias("_name"))
    n = F.length("_name")
    fits = F.coalesce(n.between(1, NAME_LIMIT), F.lit(False))
    current = dim.select(F.col(name_col).alias("_name"), F.col(id_col).alias("_old"))
    firsts = (c.filter(fits).join(current, "_name", "left_anti")
              .groupBy("_name").agg(F.min("seq").alias("_first")))
    winners = ids_by_rank(firsts, "_first", "_new", high_water_mark(dim, id_col))
    judged = c.filter(fits).join(current, "_name", "left").join(winners, "_name", "left")
    status = (F.when(F.col("_old").isNotNull(), "exists")
              .when(F.col("seq") == F.col("_first"), "inserted").otherwise("duplicate"))
    unfit = c.filter(~fits).select(
        "seq", F.when(n > NAME_LIMIT, "too long").otherwise("blank").alias("status"),
        F.lit(None).cast("bigint").alias("id"))
    outcomes = judged.select("seq", status.alias("status"), F.coalesce("_old", "_new").cast("bigint")
                             .alias("id")).unionByName(unfit)
    outcomes = outcomes.select(F.col("seq").cast("bigint").alias("seq"), "status", "id",
                               F.lit(None).cast("string").alias("detail"))
    rows = winners.select(F.col("_new").alias(id_col), F.col("_name").alias(name_col))
    return ChangeResult(dim.select(id_col, name_col).unionByName(rows), outcomes, Step(_table_of(id_col), rows=rows))


def rename_names(dim: DataFrame, id_col: str, name_col: str, changes: DataFrame,
                 changes_id_col: str = "id", changes_name_col: str = "name") -> ChangeResult:
    """Rename aisles / departments in ``seq`` order, keeping names UNIQUE.

    A request is refused (``conflict``) if another id holds its name at that
    time; a refused request changes nothing, and a name that was given up may
    be taken, so swaps over a third name work.  Of an id's granted requests
    the last is ``renamed``, earlier ones are ``superseded``.
    """
    c = _requests(changes).select("seq", F.col(changes_id_col).alias("_id"),
                                  strip(F.col(changes_name_col)).alias("_name"))
    n = F.length("_name")
    current = dim.select(F.col(id_col).alias("_id"), F.col(name_col).alias("_old"))
    valid = c.filter(n.between(1, NAME_LIMIT)).join(current.select("_id"), "_id", "left_semi")
    # a row a request, in files far smaller: not to be broadcast
    refused = refused_renames(current.select("_id", F.col("_old").alias("_name")), valid).hint("merge")
    granted = valid.join(refused, F.col("seq") == F.col("refused"), "left_anti")
    last = granted.groupBy("_id").agg(F.max_by("_name", "seq").alias("_new"),
                                      F.max("seq").alias("_last"))
    judged = (c.join(current, "_id", "left").join(last.select("_id", "_last"), "_id", "left")
              .join(refused, F.col("seq") == F.col("refused"), "left"))
    status = (F.when(F.col("_name").isNull() | (n == 0), "blank").when(n > NAME_LIMIT, "too long")
              .when(F.col("_old").isNull(), "unknown")
              .when(F.col("refused").isNotNull(), "conflict")
              .when(F.col("seq") == F.col("_last"), "renamed").otherwise("superseded"))
    outcomes = judged.select(F.col("seq").cast("bigint").alias("seq"), status.alias("status"),
                             F.col("_id").cast("bigint").alias("id"),
                             F.lit(None).cast("string").alias("detail"))
    table = (dim.join(last.select(F.col("_id").alias(id_col), "_new"), id_col, "left")
             .select(id_col, F.coalesce(F.col("_new"), F.col(name_col)).alias(name_col)))
    rows = last.select(F.col("_id").alias(id_col), F.col("_new").alias(name_col))
    return ChangeResult(table, outcomes, Step(_table_of(id_col), rows=rows, replace=True))


def guarded_delete(dim: DataFrame, id_col: str, products: DataFrame,
                   requests: DataFrame, requests_id_col: str = "id") -> ChangeResult:
    """Delete aisles / departments no product refers to.

    Reference counts are a partial aggregate of products per id; each request
    is classified with two LEFT joins (id exists, reference count).
    """
    req = requests.select("seq", F.col(requests_id_col).alias("_id"))
    refs = products.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    known = dim.select(F.col(id_col).alias("_id"), F.lit(1).alias("_k")).dropDuplicates(["_id"])
    judged = req.join(known, "_id", "left").join(refs, "_id", "left")
    status = (F.when(F.col("_k").isNull(), "unknown").when(F.col("_n") > 0, "in use")
              .otherwise("deleted"))
    outcomes = judged.select(F.col("seq").cast("bigint").alias("seq"), status.alias("status"),
                             F.col("_id").cast("bigint").alias("id"),
                             F.when(F.col("_k").isNotNull(), F.col("_n").cast("string"))
                             .alias("detail"))
    free = judged.filter(F.col("_k").isNotNull() & F.col("_n").isNull()).select(
        F.col("_id").alias(id_col))
    table = dim.join(free, id_col, "left_anti").select(*dim.columns)
    return ChangeResult(table, outcomes, Step(_table_of(id_col), gone=free))


def _id_marker(df: DataFrame, col: str, alias: str, marker: str, unique: bool) -> DataFrame:
    """(alias, marker=1) for every id of ``df``; de-duplicated unless the ids
    are a proven key (audited tables)."""
    ids = df.select(F.col(col).alias(alias), F.lit(1).alias(marker))
    return ids if unique else ids.dropDuplicates([alias])


def _product_request(changes: DataFrame, with_id: bool) -> DataFrame:
    cols = ["seq"] + (["product_id"] if with_id else [])
    return _requests(changes).select(*cols, strip(F.col("product_name")).alias("_name"),
                          F.col("aisle_id").alias("_aisle"), F.col("department_id").alias("_dept"))


def _with_fk_markers(t: Tables, req: DataFrame) -> DataFrame:
    return (req.join(_id_marker(t.aisles, "aisle_id", "_aisle", "_a", t.audited), "_aisle", "left")
            .join(_id_marker(t.departments, "department_id", "_dept", "_d", t.audited), "_dept",
                  "left"))


def _product_status(n, rest):
    """blank / too long / unknown aisle / unknown department, then ``rest``."""
    limit = MAX_LENGTH["products"]["product_name"]
    return (F.when(F.col("_name").isNull() | (n == 0), "blank").when(n > limit, "too long")
            .when(F.col("_a").isNull(), "unknown aisle")
            .when(F.col("_d").isNull(), "unknown department").otherwise(rest))


def _valid_product(n):
    limit = MAX_LENGTH["products"]["product_name"]
    return n.between(1, limit) & F.col("_a").isNotNull() & F.col("_d").isNotNull()


def insert_products(t: Tables, changes: DataFrame) -> ChangeResult:
    """Insert products (names may repeat) with ids after the high-water mark."""
    req = _with_fk_markers(t, _product_request(changes, False))
    n = F.length("_name")
    new = ids_by_rank(req.filter(_valid_product(n)), "seq", "product_id", high_water_mark(t.products, "product_id"))
    rows = new.select("product_id", F.col("_name").alias("product_name"), F.col("_aisle").alias("aisle_id"),
                      F.col("_dept").alias("department_id"))
    table = t.products.select(*rows.columns).unionByName(rows)
    judged = req.join(new.select("seq", "product_id"), "seq", "left")
    outcomes = judged.select(F.col("seq").cast("bigint").alias("seq"),
                             _product_status(n, F.lit("inserted")).alias("status"),
                             F.col("product_id").cast("bigint").alias("id"),
                             F.lit(None).cast("string").alias("detail"))
    return ChangeResult(table, outcomes, Step("products", rows=rows))


def update_products(t: Tables, changes: DataFrame) -> ChangeResult:
    """Replace name, aisle and department of existing products; the last
    valid request per product wins."""
    req = _with_fk_markers(t, _product_request(changes, True))
    n = F.length("_name")
    ok = req.filter(_valid_product(n))
    last = ok.groupBy("product_id").agg(F.max("seq").alias("_last"))
    win = ok.join(last.withColumnRenamed("_last", "seq"), ["product_id", "seq"], "left_semi")
    applied = win.join(t.products.select("product_id"), "product_id", "left_semi")
    upd = applied.select("product_id", F.col("_name").alias("_n"), "_aisle", "_dept")
    table = (t.products.join(upd, "product_id", "left")
             .select("product_id",
                     F.coalesce("_n", "product_name").alias("product_name"),
                     F.when(F.col("_n").isNotNull(), F.col("_aisle"))
                     .otherwise(F.col("aisle_id")).alias("aisle_id"),
                     F.when(F.col("_n").isNotNull(), F.col("_dept"))
                     .otherwise(F.col("department_id")).alias("department_id")))
    known = _id_marker(t.products, "product_id", "product_id", "_p", t.audited)
    judged = req.join(last, "product_id", "left").join(known, "product_id", "left")
    rest = (F.when(F.col("seq") != F.col("_last"), "superseded")
            .when(F.col("_p").isNull(), "unknown").otherwise("updated"))
    outcomes = judged.select(F.col("seq").cast("bigint").alias("seq"),
                             _product_status(n, rest).alias("status"),
                             F.col("product_id").cast("bigint").alias("id"),
                             F.lit(None).cast("string").alias("detail"))
    rows = upd.select("product_id", F.col("_n").alias("product_name"), F.col("_aisle").alias("aisle_id"),
                      F.col("_dept").alias("department_id"))
    return ChangeResult(table, outcomes, Step("products", rows=rows, replace=True))


def _ids(frame: DataFrame, id_col: str, name: str) -> DataFrame:
    col = id_col if id_col in frame.columns or len(frame.columns) != 1 else frame.columns[0]
    return frame.select(F.col(col).alias(name))


def delete_product_lines(order_details: DataFrame, product_ids: DataFrame,
                         id_col: str = "product_id") -> DataFrame:
    """Order lines minus those of the given products."""
    ids = _ids(product_ids, id_col, "product_id")
    return order_details.join(ids, "product_id", "left_anti").select(*order_details.columns)


def product_removal(product_ids: DataFrame, id_col: str = "product_id") -> list[Step]:
    """D10 + D11 as steps: the products and their order lines."""
    ids = _ids(product_ids, id_col, "product_id").distinct()
    return [Step("order_details", gone=ids), Step("products", gone=ids)]


def delete_products(t: Tables, product_ids: DataFrame, id_col: str = "product_id") -> Tables:
    """D10 + D11 as one step: the products and their order lines go together."""
    ids = _ids(product_ids, id_col, "product_id")
    return t.with_(products=t.products.join(ids, "product_id", "left_anti")
                   .select(*t.products.columns),
                   order_details=delete_product_lines(t.order_details, ids))


def cascade_delete(t: Tables, table: str, keys: DataFrame) -> Tables:
    """Delete rows of ``table`` whose primary key is in ``keys`` and,
    following ON DELETE CASCADE, every row that depends on them.

    ``keys`` holds the key column(s) by name (or one column for a one-column
    key).  Tables are visited parents-first; a child loses the rows whose
    foreign key hits a removed parent (anti join), and the keys it loses are
    passed on (semi join) only if it has children itself.  Nothing is
    collected.
    """
    pk = PRIMARY_KEYS[table]
    if len(pk) == 1 and keys.columns != pk:
        keys = keys.select(F.col(keys.columns[0]).alias(pk[0]))
    conditions = {table: [(pk, keys.select(*pk).distinct())]}
    current = dict(t.items())
    for name in TABLE_ORDER:
        if name not in conditions:
            continue
        before = current[name]
        kept = before
        for cols, k in conditions[name]:
            kept = kept.join(k, cols, "left_anti")
        current[name] = kept.select(*before.columns)
        children = children_of(name)
        if children:
            removed = _union([before.join(k, cols, "left_semi")
                              for cols, k in conditions[name]])
        for fk in children:
            parent_keys = removed.select(F.col(fk.parent_column).alias(fk.column)).distinct()
            conditions.setdefault(fk.table, []).append(([fk.column], parent_keys))
    return Tables(**current)
