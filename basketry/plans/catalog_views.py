"""Catalogue reads: listings, name lookups, reference counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.tables import Tables


def list_aisles(t: Tables) -> DataFrame:
    """(aisle_id, aisle) by name."""
    return t.aisles.select("aisle_id", "aisle").orderBy(F.col("aisle").asc_nulls_last(),
                                                        "aisle_id")


def list_departments(t: Tables) -> DataFrame:
    """(department_id, department) by name."""
    return (t.departments.select("department_id", "department")
            .orderBy(F.col("department").asc_nulls_last(), "department_id"))


def _lookup(dim: DataFrame, id_col: str, name_col: str, names: DataFrame,
            names_col: str) -> DataFrame:
    wanted = names.select(F.col(names_col).alias(name_col)).dropDuplicates()
    return wanted.join(dim.select(name_col, id_col), name_col)


def lookup_aisles(t: Tables, names: DataFrame, names_col: str = "aisle") -> DataFrame:
    """R11, in bulk: (aisle, aisle_id) for every name of ``names`` that exists."""
    return _lookup(t.aisles, "aisle_id", "aisle", names, names_col)


def lookup_departments(t: Tables, names: DataFrame,
                       names_col: str = "department") -> DataFrame:
    """R12, in bulk: (department, department_id) for every existing name."""
    return _lookup(t.departments, "department_id", "department", names, names_col)


def _refcount(dim: DataFrame, key: str, products: DataFrame) -> DataFrame:
    counts = products.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return (dim.select(key).join(counts, key, "left")
            .select(key, F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("products")))


def refcount_aisles(t: Tables) -> DataFrame:
    """R13, for every aisle: (aisle_id, products linked to it), 0 if none."""
    return _refcount(t.aisles, "aisle_id", t.products)


def refcount_departments(t: Tables) -> DataFrame:
    """R14, for every department: (department_id, products), 0 if none."""
    return _refcount(t.departments, "department_id", t.products)
