"""Shared by the tests of the llm subpackage."""
import math

import duckdb

from basketry.llm import queries
from basketry.llm.oracles import SQL

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark", "conversations")


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def duck(frames=None):
    """A connection with the tables as views, or with given pandas frames."""
    con = duckdb.connect()
    for name in TABLES:
        if frames and name in frames:
            con.register(name, frames[name])
        else:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def same_as_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF)
    cur = duck().execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(columns, cur.fetchall())


def docs(spark, rows, schema="doc_id long, text string, lang string, source string"):
    """Documents with missing values where a row is short."""
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)
