"""Change sets as data: what a batch of edits adds to and takes from a table.

A `Step` names rows to add and keys whose rows go; the operators of
`basketry.operators.catalog` give one with their result, a snapshot stores it
(`basketry.sources.snapshot.publish_change`), and `audit_delta` judges it.  The
size of a step is the size of the edit, not of the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.audit import (ROW_COUNT, _row_rules, rule_fk, rule_key)
from basketry.schema import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, TABLE_ORDER, UNIQUE, children_of
from basketry.tables import Tables


#: Kept keys that a task looks through for repeated ones, about.
TASK_KEYS = 250_000


@dataclass(frozen=True)
class Step:
    """First the rows whose key columns (those of ``gone``) stand in ``gone`` go,
    or with ``replace`` those with the primary keys of ``rows``; then ``rows``
    come."""
    table: str
    rows: DataFrame | None = None
    gone: DataFrame | None = None
    replace: bool = False

    def removed(self) -> DataFrame | None:
        return self.rows.select(*PRIMARY_KEYS[self.table]) if self.replace else self.gone

    def added(self) -> DataFrame | None:
        """The rows in the table's declared columns and types."""
        if self.rows is None:
            return None
        return self.rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[self.table].fields])


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose values in the columns of ``keys`` are not there."""
    return df.join(keys, keys.columns, "left_anti").select(*df.columns)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _folded(table: str, start: DataFrame | None, steps: list[Step]) -> DataFrame | None:
    """``start`` (None: no rows) after the steps of ``table``."""
    for s in (s for s in steps if s.table == table):
        removed, added = s.removed(), s.added()
        if start is not None and removed is not None:
            start = without(start, removed)
        if added is not None:
            start = added if start is None else start.unionByName(added)
    return start


def apply(t: Tables, steps: list[Step]) -> Tables:
    """The tables after the steps, in their order; no longer audited."""
    return Tables(**{name: _folded(name, df, steps) for name, df in t.items()})


def cascade_steps(t: Tables, table: str, keys: DataFrame) -> list[Step]:
    """`catalog.cascade_delete` as steps: per table the keys of the rows to go,
    those of a dependent table by its foreign key, so a removed order is one key
    however many lines it has."""
    pk = PRIMARY_KEYS[table]
    if len(pk) == 1 and keys.columns != pk:
        keys = keys.select(F.col(keys.columns[0]).alias(pk[0]))
    gone, steps = {table: [keys.select(*pk).distinct()]}, []
    for name in TABLE_ORDER:  # parents before children
        steps += [Step(name, gone=k) for k in gone.get(name, [])]
        for fk in children_of(name) if name in gone else []:
            parts = [k if k.columns == [fk.parent_column]
                     else getattr(t, name).join(k, k.columns, "left_semi") for k in gone[name]]
            parts = [p.select(F.col(fk.parent_column).alias(fk.column)) for p in parts]
            gone.setdefault(fk.table, []).append(_union(parts).distinct())
    return steps


def _violations(table: str, rule: str, bad: DataFrame, count) -> DataFrame:
    return bad.agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), "violations")


def _twice(table: str, kind: str, columns: list[str], kept: DataFrame, new: DataFrame, rows: int | None) -> DataFrame:
    """Keys of new rows that occur more than once, among them or with a kept row.

    New and kept keys meet in one aggregate; with more than about `TASK_KEYS`
    kept rows a task (``rows``, if known) they are dealt to more tasks."""
    keys = new.select(*columns).na.drop("any")
    low, high = keys.agg(F.min(columns[0]), F.max(columns[0])).first()
    near = kept.select(*columns).filter(F.col(columns[0]).between(low, high))  # pushed to the scan
    both = keys.withColumn("_new", F.lit(1)).unionByName(near.withColumn("_new", F.lit(0)))
    parts = -(-(rows or 0) // TASK_KEYS)
    if parts > int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = both.repartition(parts, *columns)
    found = both.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), F.max("_new").alias("_new"))
    return _violations(table, rule_key(kind, columns), found.filter("_n > 1 AND _new = 1"), F.count(F.lit(1)))


def audit_delta(before: Tables, steps: list[Step], include_clean: bool = False) -> DataFrame:
    """(table, rule, violations) of ``apply(before, steps)`` for ``before`` that
    is known to be clean, as `audit` would give them, from the steps.

    Only new rows can break a row rule; only new keys can repeat, and are looked
    up within their range of the key column; only new rows and the children of
    keys that are gone can be orphans.  Children whose own step takes all rows
    of those keys need no look at all, so a cascade reads no table.
    """
    kept, new, parts = {}, {}, []
    touched = {s.table for s in steps}
    for name, df in before.items():
        kept[name] = reduce(without, [r for s in steps if s.table == name
                                      for r in [s.removed()] if r is not None], df)
        rows = _folded(name, None, steps)
        new[name] = None if rows is None or rows.isEmpty() else rows
    for name in TABLE_ORDER:
        rows = new[name]
        if rows is None:
            continue
        rules = _row_rules(name)
        counted = rows.agg(*[c.alias(f"r{i}") for i, (_, c) in enumerate(rules)])
        parts.append(counted.select(F.lit(name).alias("table"), F.inline(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.coalesce(f"r{i}", F.lit(0)).cast("bigint").alias("violations"))
            for i, (rule, _) in enumerate(rules)]))))
        parts.append(_twice(name, "primary key", PRIMARY_KEYS[name], kept[name], rows, before.known_rows(name)))
        if name in UNIQUE:
            parts.append(_twice(name, "unique", UNIQUE[name], kept[name], rows, before.known_rows(name)))
    for fk in FOREIGN_KEYS:
        found = []
        parent_rows = [p for p in (kept[fk.parent], new[fk.parent]) if p is not None]
        if new[fk.table] is not None:
            child = new[fk.table].select(F.col(fk.column).alias("_k")).filter("_k IS NOT NULL").groupBy("_k").agg(
                F.count(F.lit(1)).alias("_n"))
            low, high = child.agg(F.min("_k"), F.max("_k")).first()
            for p in parent_rows:
                near = p.select(F.col(fk.parent_column).alias("_k")).filter(F.col("_k").between(low, high))
                child = child.join(near, "_k", "left_anti")
            found.append(child)
        if fk.parent in touched:
            gone = _gone_keys(before, steps, fk)
            if new[fk.parent] is not None:
                gone = gone.join(new[fk.parent].select(F.col(fk.parent_column).alias("_k")), "_k", "left_anti")
            for s in steps:  # taken along by a step of the child's own
                if s.table == fk.table and s.gone is not None and s.gone.columns == [fk.column]:
                    gone = gone.join(s.gone.select(F.col(fk.column).alias("_k")), "_k", "left_anti")
            if not gone.isEmpty():
                found.append(kept[fk.table].select(F.col(fk.column).alias("_k")).groupBy("_k").agg(
                    F.count(F.lit(1)).alias("_n")).join(gone, "_k", "left_semi"))
        if found:
            parts.append(_violations(fk.table, rule_fk(fk.column, fk.parent, fk.parent_column),
                                     _union([f.select("_k", "_n") for f in found]), F.sum("_n")))
    spark = before.spark
    out = _union(parts) if parts else spark.createDataFrame([], "table string, rule string, violations bigint")
    out = out.filter(F.col("rule") != ROW_COUNT)
    return out if include_clean else out.filter(F.col("violations") > 0)


def _gone_keys(before: Tables, steps: list[Step], fk) -> DataFrame:
    """(_k): the parent's keys that some step takes, each once."""
    parent, column, parts = getattr(before, fk.parent), fk.parent_column, []
    for s in steps:
        keys = s.removed() if s.table == fk.parent else None
        if keys is None:
            continue
        if keys.columns != [column]:
            keys = parent.join(keys, keys.columns, "left_semi")
        parts.append(keys.select(F.col(column).alias("_k")))
    if not parts:
        return before.spark.createDataFrame([], "_k bigint")
    return _union(parts).distinct()
