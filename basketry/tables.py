"""The six-table bundle every operator consumes and returns."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession

from basketry.schema import SCHEMAS, TABLE_ORDER


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    departments: DataFrame
    aisles: DataFrame
    products: DataFrame
    orders: DataFrame
    order_details: DataFrame
    # True only for tables read back from a published (audited) snapshot:
    # declared keys are then known to be unique and non-NULL, and operators
    # may skip work that only matters when they are not.
    audited: bool = False
    # Exact row counts per table when known (recorded at publication), so
    # broadcast decisions can rest on a proven size without running a job.
    row_counts: dict | None = field(default=None, compare=False, hash=False)

    def items(self):
        return [(name, getattr(self, name)) for name in TABLE_ORDER]

    def with_(self, **changes) -> "Tables":
        """A copy with some tables replaced; replaced data is no longer audited."""
        return replace(self, audited=False, row_counts=None, **changes)

    def known_rows(self, name: str) -> int | None:
        return (self.row_counts or {}).get(name)

    def conform(self) -> "Tables":
        """Project and cast every table to its declared schema (column order too)."""
        out = {}
        for name, df in self.items():
            out[name] = df.select([df[f.name].cast(f.dataType).alias(f.name)
                                   for f in SCHEMAS[name].fields])
        return Tables(**out, audited=self.audited, row_counts=self.row_counts)

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` under their own names."""
        for name, df in self.items():
            df.createOrReplaceTempView(prefix + name)

    @property
    def spark(self) -> SparkSession:
        return self.users.sparkSession


TABLE_NAMES = [f.name for f in fields(Tables) if f.name not in ("audited", "row_counts")]
