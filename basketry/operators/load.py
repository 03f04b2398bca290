"""Cleaning and normalisation of the wide order-line frame.

The reference drops exact duplicate rows, then every row with a missing
value, and projects the rest onto the six tables: ``departments`` and
``aisles`` keep the first name seen per id, the others are distinct
projections.  Here the distinct projections are taken straight from the
null-free rows — ``distinct(project(distinct(rows)))`` equals
``distinct(project(rows))`` — so the full-width row dedup is not needed on
the way to the tables; `clean_wide` offers it when the cleaned rows
themselves are wanted.

A row with a field that is present but cannot be taken (``_bad``, see
`basketry.sources.csv`) and with nothing missing makes `complete_rows`,
`clean_wide` and `normalise` fail; `rejects` counts such rows, and
``keep_out=True`` leaves them out instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.schema import DEFAULTS, SCHEMAS
from basketry.tables import Tables

POSITION = ["_file", "_block", "_row"]


def data_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if not c.startswith("_")]


def _is_bad(wide: DataFrame):
    return F.size("_bad") > 0 if "_bad" in wide.columns else F.lit(False)


def _nothing_missing(wide: DataFrame):
    """True for rows that S3 keeps: every field has a value or an unparsable one."""
    def present(c):
        there = F.col(c).isNotNull()
        return there | F.array_contains("_bad", c) if "_bad" in wide.columns else there
    return reduce(lambda a, b: a & b, [present(c) for c in data_columns(wide)])


def _present(wide: DataFrame) -> list:
    """Per data column a condition that its value is there, neither null nor NaN
    (as ``na.drop`` has it, but each can be judged where its column comes from,
    which then need not travel through the joins of ``wide``)."""
    floats = {f.name for f in wide.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return [F.col(c).isNotNull() & ~F.isnan(c) if c in floats else F.col(c).isNotNull() for c in data_columns(wide)]


def complete_rows(wide: DataFrame, keep_out: bool = False) -> DataFrame:
    """S3: rows with no missing value in any data column.

    A row kept by that rule whose ``_bad`` is not empty fails the job, or is
    left out with ``keep_out``.
    """
    if "_bad" not in wide.columns:
        return wide.filter(reduce(lambda a, b: a & b, _present(wide)))
    refuse = (F.lit(False) if keep_out else F.raise_error(F.concat(
        F.lit("unusable fields in an order line: "), F.array_join("_bad", ", "))).cast("boolean"))
    return wide.filter(F.when(_nothing_missing(wide) & _is_bad(wide), refuse)
                       .otherwise(_nothing_missing(wide)))


def rejects(wide: DataFrame) -> DataFrame:
    """(file, rule, violations): lines per file that S3 keeps but that hold a
    field that cannot be taken, by what is wrong."""
    bad = wide.filter(_nothing_missing(wide) & _is_bad(wide))
    return (bad.select(F.col("_file").alias("file"), F.explode("_bad").alias("rule"))
            .groupBy("file", "rule").agg(F.count(F.lit(1)).alias("violations")))


def stage(wide: DataFrame, path: str) -> DataFrame:
    """Write the wide rows once and read them back, incomplete rows left out:
    completeness needs every column, so it is settled here, and each
    projection of the staged rows reads only its own columns.  Rows with
    unusable fields stay, marked in ``_bad``."""
    wide.filter(_nothing_missing(wide)).write.mode("errorifexists").parquet(path)
    return wide.sparkSession.read.parquet(path)


def clean_wide(wide: DataFrame, keep_out: bool = False) -> DataFrame:
    """S2 + S3: distinct complete rows over the data columns (positions dropped)."""
    return complete_rows(wide, keep_out).select(data_columns(wide)).dropDuplicates()


def with_defaults(wide: DataFrame) -> DataFrame:
    """Declared default values for columns the input does not have."""
    absent = {c: F.lit(v) for table in ("orders", "order_details")
              for c, v in DEFAULTS[table].items() if c not in wide.columns}
    return wide.withColumns(absent) if absent else wide


def _keep_first(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key, the value of the first row in file order.

    ``min_by`` is a partial aggregate, so a key holding most rows costs one
    row per task before the shuffle.  Without position columns (a frame not
    read from files) the smallest value wins, which is deterministic.
    """
    if all(c in rows.columns for c in POSITION):
        order = F.struct(*[F.col(c) for c in POSITION])
    else:
        order = F.col(value)
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def normalise(wide: DataFrame, keep_out: bool = False, staged: bool = False) -> Tables:
    """The six tables from the wide frame (lazy; share one input).

    ``staged`` says that the rows come from `stage` and hold nothing unusable,
    so no column beyond a table's own is read.
    """
    wide = with_defaults(wide)
    rows = wide if staged else complete_rows(wide, keep_out)

    def distinct(table: str) -> DataFrame:
        return rows.select([f.name for f in SCHEMAS[table].fields]).distinct()

    return Tables(
        users=distinct("users"),
        departments=_keep_first(rows, "department_id", "department"),
        aisles=_keep_first(rows, "aisle_id", "aisle"),
        products=distinct("products"),
        orders=distinct("orders"),
        order_details=distinct("order_details"),
    ).conform()
