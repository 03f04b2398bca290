"""SQL text over the basket tables.

``run_sql`` binds named parameters (``:name`` markers) through Spark's own
parameterised SQL, never by string formatting; a trailing semicolon, which
Spark's parser rejects, is cut.  ``run_sql_file`` reads the text from a file.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame

from basketry.tables import Tables

PACKAGE_SQL = os.path.join(os.path.dirname(os.path.dirname(__file__)), "sql")


def run_sql(tables: Tables, text: str, params: dict | None = None) -> DataFrame:
    """The query's DataFrame.  The tables are temp views only while Spark
    resolves the text; the caller's own views of those names come back after."""
    spark = tables.spark
    own = {v.name: spark.table(v.name) for v in spark.catalog.listTables()
           if v.isTemporary and v.name in dict(tables.items())}
    tables.register_views()
    try:
        return spark.sql(re.sub(r";\s*$", "", text.strip()), args=params or None)
    finally:
        for name, _ in tables.items():
            if name in own:
                own[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def run_sql_file(tables: Tables, path: str, params: dict | None = None) -> DataFrame:
    """`run_sql` of a UTF-8 file: ``path`` itself, or one shipped in ``sql/``."""
    for candidate in (path, os.path.join(PACKAGE_SQL, path)):
        if os.path.isfile(candidate):
            with open(candidate, encoding="utf-8") as f:
                return run_sql(tables, f.read(), params)
    raise FileNotFoundError(f"no SQL file at {path!r}, and none of that name in {PACKAGE_SQL}")
