"""basketry: grocery-basket analytics on Spark DataFrames.

Entry points: `basketry.sources` (CSV, snapshots, SQL text, generated
inputs), `basketry.operators` (load, audit, catalogue change sets) and
`basketry.plans` (the read queries).  Every function takes and returns
DataFrames or a `basketry.tables.Tables` bundle; nothing is collected.
"""

from basketry.tables import Tables  # noqa: F401
