"""Constraint audit (I1-I6): one row per violated rule, nothing collected.

Spark does not enforce keys or checks, so a snapshot is audited before it is
published.  Every rule is a set-oriented job over the whole table:

* per table, ONE scan grouped by the primary key counts keys occurring more
  than once together with NULLs in NOT NULL / key columns, failed CHECKs (a
  NULL result passes, as in SQL) and over-long strings;
* UNIQUE columns: names occurring more than once (``groupBy(name).count()``,
  partially aggregated, so a hot name is cheap);
* foreign keys: rows counted per non-NULL child key, then keys without a parent
  (``left_anti`` join).

The result has columns (table, rule, violations) and is empty for a clean
snapshot.  Its size is bounded by the number of declared rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.schema import CHECKS, FOREIGN_KEYS, MAX_LENGTH, NOT_NULL, PRIMARY_KEYS, UNIQUE
from basketry.tables import Tables


ROW_COUNT = "row count"  # not a rule: the table's size, reported by audit_with_counts


def rule_not_null(column: str) -> str:
    return f"not null {column}"


def rule_check(name: str) -> str:
    return f"check {name}"


def rule_length(column: str, n: int) -> str:
    return f"length {column} <= {n}"


def rule_key(kind: str, columns: list[str]) -> str:
    return f"{kind} ({', '.join(columns)})"


def rule_fk(column: str, parent: str, parent_column: str) -> str:
    return f"foreign key {column} -> {parent}.{parent_column}"


def _row_rules(table: str) -> list[tuple[str, object]]:
    """(rule, Column counting violations) for the single-pass rules of a table."""
    rules = []
    not_null = list(dict.fromkeys(PRIMARY_KEYS.get(table, []) + NOT_NULL.get(table, [])))
    for c in not_null:
        rules.append((rule_not_null(c), F.count_if(F.col(c).isNull())))
    for chk in CHECKS:
        if chk.table == table:
            rules.append((rule_check(chk.name), F.count_if(~F.expr(chk.condition))))
    for c, n in MAX_LENGTH.get(table, {}).items():
        rules.append((rule_length(c, n), F.count_if(F.length(c) > n)))
    return rules


def _table_pass(table: str, df: DataFrame) -> DataFrame:
    """Row rules and primary-key duplicates of one table in one scan.

    Rows are grouped by the key (one shuffle, needed for the duplicate test
    anyway) carrying per-row rule flags; the second level sums the flags and
    counts keys seen more than once.  NULL keys are grouped too but never
    count as duplicates (NOT NULL reports them).
    """
    rules = _row_rules(table)
    pk = PRIMARY_KEYS[table]
    per_key = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_rows"),
                                  *[col.alias(f"r{i}") for i, (_, col) in enumerate(rules)])
    key_ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pk])
    counts = per_key.agg(F.count_if(key_ok & (F.col("_rows") > 1)).alias("pk"),
                         F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
                         *[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(rules))])
    pairs = F.array(
        F.struct(F.lit(ROW_COUNT).alias("rule"), F.col("rows").alias("violations")),
        F.struct(F.lit(rule_key("primary key", pk)).alias("rule"),
                 F.col("pk").alias("violations")),
        *[F.struct(F.lit(name).alias("rule"),
                   F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("violations"))
          for i, (name, _) in enumerate(rules)])
    return counts.select(F.lit(table).alias("table"), F.inline(pairs))


def _duplicates(table: str, df: DataFrame, kind: str, cols: list[str]) -> DataFrame:
    dup = (df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
           .groupBy(*cols).count().filter(F.col("count") > 1))
    return dup.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table"), F.lit(rule_key(kind, cols)).alias("rule"), "violations")


def _orphans(tables: Tables, fk) -> DataFrame:
    """Child rows without a parent: rows are counted per key first (combined
    before the shuffle, so a hot key is one row per task), then the keys are
    matched."""
    child = (getattr(tables, fk.table).select(F.col(fk.column).alias("_k"))
             .filter(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("_n")))
    parent = getattr(tables, fk.parent).select(F.col(fk.parent_column).alias("_k"))
    missing = child.join(parent, "_k", "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")).select(
        F.lit(fk.table).alias("table"),
        F.lit(rule_fk(fk.column, fk.parent, fk.parent_column)).alias("rule"), "violations")


def audit(tables: Tables, include_clean: bool = False) -> DataFrame:
    """(table, rule, violations) for every declared rule that is broken."""
    out = audit_with_counts(tables).filter(F.col("rule") != ROW_COUNT)
    return out if include_clean else out.filter(F.col("violations") > 0)


def audit_with_counts(tables: Tables) -> DataFrame:
    """Every rule's count (broken or not) plus one ``row count`` row per table,
    all from the same scans."""
    parts = []
    for name, df in tables.items():
        parts.append(_table_pass(name, df))
        if name in UNIQUE:
            parts.append(_duplicates(name, df, "unique", UNIQUE[name]))
    parts.extend(_orphans(tables, fk) for fk in FOREIGN_KEYS)
    return reduce(DataFrame.unionByName, parts).select(
        "table", "rule", F.col("violations").cast("bigint").alias("violations"))

