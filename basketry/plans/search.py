"""Product search and product / aisle listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import contains_pattern
from basketry.sources.name_index import NameIndex
from basketry.tables import Tables

SEARCH_LIMIT = 500  # the reference caps search and edit lists at 500 rows
BROADCAST_IDS = 100_000  # winners' ids sent to every task: 800 KB at most


def _winners(t: Tables, text: str, department: str | None, limit: int,
             index: NameIndex | None = None) -> DataFrame:
    """The first ``limit`` matching products by (name, id): the answer's rows.

    The order does not involve the sums, so the winners are picked before any
    order line is read.  With an index only its candidates are matched.
    """
    products = t.products
    if text:
        pattern = contains_pattern(text)
        found = index.candidates(pattern) if index else None
        if found is not None:
            products = products.join(found, "product_id", "left_semi")
        products = products.filter(F.col("product_name").ilike(pattern))
    else:  # '%%' matches every non-NULL name
        products = products.filter(F.col("product_name").isNotNull())
    departments = t.departments
    if department is not None:
        departments = departments.filter(F.col("department") == F.lit(department))
    return (products.join(t.aisles, "aisle_id").join(departments, "department_id")
            .select("product_id", "product_name", "aisle", "department")
            .orderBy(F.col("product_name").asc_nulls_last(), F.col("product_id").asc_nulls_last())
            .limit(limit))


def _with_reorders(winners: DataFrame, lines: DataFrame) -> DataFrame:
    """Winners with the reorders of their lines; unsold products (LEFT join) have 0."""
    reorders = lines.groupBy("product_id").agg(F.sum("reordered").alias("_reorders"))
    return (winners.join(reorders, "product_id", "left")
            .select("product_id", "product_name", "aisle", "department",
                    F.coalesce(F.col("_reorders"), F.lit(0)).cast("bigint")
                    .alias("total_reorders"))
            .orderBy(F.col("product_name").asc_nulls_last(), F.col("product_id").asc_nulls_last()))


def _lines_of(t: Tables, winners: DataFrame, limit: int) -> DataFrame:
    """The order lines of the winners: a map-side semi join, as the winners are
    at most ``limit`` ids, eight bytes each; a larger ``limit`` leaves the join
    to the planner."""
    ids = winners.select("product_id")
    ids = F.broadcast(ids) if limit <= BROADCAST_IDS else ids
    return t.order_details.select("order_id", "product_id", "reordered").join(
        ids, "product_id", "left_semi")


def product_search(t: Tables, text: str = "", department: str | None = None,
                   hours: tuple[int, int] = (0, 23), limit: int = SEARCH_LIMIT,
                   index: NameIndex | None = None) -> DataFrame:
    """Products whose name contains ``text`` (case-insensitive, LIKE
    wildcards live), optionally in one department, with all-time reorders.
    ``index`` (`snapshot.read_names`) spares matching all products.

    ``hours`` is accepted as the reference accepts it and, as there, does not
    change the result: its filter sits on the outer-joined orders while the
    sum is over order lines (SURVEY Q1).  `product_search_hourly` applies it.
    """
    del hours
    winners = _winners(t, text, department, limit, index)
    return _with_reorders(winners, _lines_of(t, winners, limit))


def product_search_hourly(t: Tables, text: str = "", department: str | None = None,
                          hours: tuple[int, int] = (0, 23),
                          limit: int = SEARCH_LIMIT) -> DataFrame:
    """As `product_search`, counting only reorders placed in ``hours``."""
    lo, hi = hours
    winners = _winners(t, text, department, limit)
    in_band = (t.orders.filter(F.col("order_hour_of_day").between(lo, hi))
               .select("order_id"))
    return _with_reorders(winners, _lines_of(t, winners, limit).join(in_band, "order_id", "left_semi"))


def product_search_banded(t: Tables, text: str = "", department: str | None = None,
                          hours: tuple[int, int] = (0, 23),
                          limit: int = SEARCH_LIMIT) -> DataFrame:
    """R6 with its outer join spelled out (J5): as `product_search`, and
    ``band_lines``, how many of a product's lines stand in an order placed in
    ``hours``.

    The band is part of the join condition on the orders' side, so lines of
    other hours keep their row (and their reorders), and unsold products stay
    with 0 and 0.
    """
    lo, hi = hours
    winners = _winners(t, text, department, limit)
    orders = t.orders.select(F.col("order_id").alias("_order"), "order_hour_of_day")
    lines = _lines_of(t, winners, limit)
    placed = lines.join(orders, (lines.order_id == orders["_order"])
                        & orders.order_hour_of_day.between(lo, hi), "left")
    sums = placed.groupBy("product_id").agg(F.sum("reordered").alias("_reorders"), F.count("_order").alias("_band"))
    return (winners.join(sums, "product_id", "left")
            .select("product_id", "product_name", "aisle", "department",
                    F.coalesce("_reorders", F.lit(0)).cast("bigint").alias("total_reorders"),
                    F.coalesce("_band", F.lit(0)).cast("bigint").alias("band_lines"))
            .orderBy(F.col("product_name").asc_nulls_last(), F.col("product_id").asc_nulls_last()))


def aisles_of_department(t: Tables, department_id: int | None = None) -> DataFrame:
    """Aisles holding products of a department, by aisle name.

    With ``department_id=None`` it answers for every department at once
    (department_id, aisle_id, aisle); with an id, (aisle_id, aisle).
    """
    pairs = t.products.select("department_id", "aisle_id")
    if department_id is not None:
        pairs = pairs.filter(F.col("department_id") == F.lit(department_id))
    pairs = pairs.dropDuplicates()
    out = t.aisles.join(pairs, "aisle_id")
    if department_id is not None:
        return (out.select("aisle_id", "aisle").dropDuplicates()
                .orderBy(F.col("aisle").asc_nulls_last(), "aisle_id"))
    return (out.select("department_id", "aisle_id", "aisle")
            .orderBy("department_id", F.col("aisle").asc_nulls_last(), "aisle_id"))


def products_filtered(t: Tables, department_id: int | None = None,
                      aisle_id: int | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The edit list — products of an optional department / aisle by name."""
    p = t.products
    if department_id is not None:
        p = p.filter(F.col("department_id") == F.lit(department_id))
    if aisle_id is not None:
        p = p.filter(F.col("aisle_id") == F.lit(aisle_id))
    return (p.select("product_id", "product_name", "aisle_id", "department_id")
            .orderBy(F.col("product_name").asc_nulls_last(), F.col("product_id").asc_nulls_last())
            .limit(limit))


def product_search_sql(t: Tables, text: str = "", department: str | None = None,
                       hours: tuple[int, int] = (0, 23)) -> DataFrame:
    """R6 as parameterised SQL text (S9 + S10): the shipped SQL file with
    named parameters bound by Spark; ``hours`` as in `product_search`."""
    del hours
    from basketry.sources.sql import run_sql_file
    return run_sql_file(t, "product_search.sql", {
        "pattern": contains_pattern(text), "department": department})


def product_search_banded_sql(t: Tables, text: str = "", department: str | None = None,
                              hours: tuple[int, int] = (0, 23)) -> DataFrame:
    """`product_search_banded` as parameterised SQL text (S9 + S10), the hours
    bound like the others."""
    from basketry.sources.sql import run_sql_file
    return run_sql_file(t, "product_search_banded.sql", {
        "pattern": contains_pattern(text), "department": department,
        "from_hour": hours[0], "to_hour": hours[1]})
