"""Wide CSV source (S1): one header CSV, or a folder or glob of them, of order lines.

Every file's own header names its columns, so files may order them
differently; files that name other columns are refused.  Every field is read
as text, the missing-value tokens pandas recognises by default become NULL (in
text columns too), and the known columns are then cast to their declared
types.  What cannot be taken as it stands is not dropped or cut silently but
listed in ``_bad``: the name of a column whose field is present and does not
parse (``abc`` in an integer column, or ``2.5`` for an id: our rule, ids are
integers), and SURPLUS for a line with more fields than its header.  A short
line's missing fields are missing values, as for pandas.

``_file``, ``_block`` and ``_row`` record the position of each record's first
line (file, split start, increasing id within the split) for keep-first rules.

Files are split across tasks, and quoted fields may hold newlines.  One job
over the lines finds the headers and counts quotes per split; a prefix sum over
a file's splits tells whether a split begins inside a quoted field.  Files in
which no line ends inside one are read as they are, line by line.  Of the other
files only splits that hold such a line are written dealt by split, to number
their records by the running quote count and to join the lines of each; of the
records that go on in later splits the rest is joined to them.  A file that
ends inside a quoted field is refused.
"""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.schema import DEFAULTS, WIDE_COLUMNS
from basketry.session import scratch_path

# ---- fixed values: pandas.read_csv default missing-value tokens ----------------
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# ---- end of fixed values ----------------------------------------------------------

#: Files that a task has open at once when it deals lines; with more it sorts the rest, which may spill.
WRITERS = 16
#: Buckets a split, so that few splits share one; at most so many, Spark's limit.
BUCKETS, MOST_BUCKETS = 4, 100_000

POSITION_COLUMNS = ["_file", "_block", "_row"]
SURPLUS = "surplus fields"


def _number(raw: Column, dtype: T.DataType) -> Column | None:
    """A field's text as a number, null if it is none; None for text columns."""
    # pandas turns an integer column with gaps into floats ("2.0")
    kind = "decimal(38,10)" if isinstance(dtype, T.LongType) else "double" if isinstance(dtype, T.DoubleType) else None
    return kind and raw.try_cast(kind)


def _checked(number: Column, there: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """(typed value, parse-failed flag) from a field's number."""
    if isinstance(dtype, T.LongType):
        # accept integral decimals, reject fractions and non-numbers
        ok = (number.isNotNull() & (number == F.floor(number))
              & (F.abs(number) < F.lit(str(2 ** 63)).cast("decimal(38,0)")))
        return F.when(ok, number.cast("bigint")), there & ~ok
    return number, there & number.isNull()


def _once(df: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """`df` with the columns `keep` and `made`, the latter by a generator, so that
    each is worked out once, not once a reference to it."""
    return df.select(*keep, F.inline(F.array(F.struct(*made))))


def typed_wide(text: DataFrame, na_tokens=PANDAS_NA_TOKENS) -> DataFrame:
    """Map NA tokens to NULL and cast the known wide columns; extra columns stay text."""
    tokens = list(na_tokens)
    known = dict(WIDE_COLUMNS)
    data_cols = [c for c in text.columns if c not in [*POSITION_COLUMNS, "_surplus"]]
    missing = [c for c in known if c not in data_cols
               and c not in DEFAULTS.get("orders", {}) and c not in DEFAULTS.get("order_details", {})]
    if missing:
        raise ValueError(f"wide input lacks columns {missing}")
    read, out, bad = [], [], []
    for i, c in enumerate(data_cols):
        raw = F.when(~F.col(c).isin(tokens), F.col(c)) if tokens else F.col(c)
        number = _number(raw, known.get(c))
        if number is None:
            read.append(raw.alias(c))
            out.append(F.col(c))
            continue
        read += [number.alias(c), raw.isNotNull().alias(f"_has{i}")]
        val, failed = _checked(F.col(c), F.col(f"_has{i}"), known[c])
        out.append(val.alias(c))
        bad.append(F.when(failed, F.lit(c)))
    if "_surplus" in text.columns:
        bad.append(F.when(F.col("_surplus"), F.lit(SURPLUS)))
    # Declared defaults for columns the file does not have.
    for table in ("orders", "order_details"):
        for c, v in DEFAULTS[table].items():
            if c not in data_cols:
                out.append(F.lit(v).cast(known[c]).alias(c))
    pos = [c for c in POSITION_COLUMNS if c in text.columns]
    keep = [*pos, *[c for c in ["_surplus"] if c in text.columns]]
    bad_col = F.array_compact(F.array(*bad)) if bad else F.array()
    rows = _once(_once(text, keep, read), pos, [*out, bad_col.cast("array<string>").alias("_bad")])
    return rows.select(*[c for c in rows.columns if c not in [*pos, "_bad"]], *pos, "_bad")


def _as_path(name: str) -> str:
    """A file's name as Spark reports it, as a path that a reader takes literally."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(name))


def _lines(spark: SparkSession, paths, encoding: str) -> DataFrame:
    """(_file, _block, _row, line, quotes): the physical lines of the files."""
    text = spark.read.option("lineSep", "\n").option("encoding", encoding).text(paths)
    return text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"),
                       (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def _splits(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """One row a split: _file, _block, lines, whether it begins within quotes
    (`inside`), how many lines have an odd number of quotes (`odd`), whether its
    lines must be numbered (`ragged`: it begins there, a line ends there, or it
    has the file's header), whether a line of the file ends within quotes
    (`folded`) and the file does (`unclosed`), and the file's first line
    (`header`)."""
    odd = F.col("quotes") % 2
    # an aggregate that gives text would sort all lines by split; beside one that
    # collects (the split's own start, so one value), Spark hashes the few splits of a task
    per_split = _lines(spark, path, encoding).groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(odd).alias("odd"),
        F.min_by(F.when(F.col("_block") == 0, F.col("line")), "_row").alias("first"),
        F.collect_set("_block").alias("hashed")).filter(F.size("hashed") == 1)
    whole = Window.partitionBy("_file")  # one row a split
    before = F.coalesce(F.sum("odd").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = per_split.select(
        "_file", "_block", "lines", "odd", (before % 2 == 1).alias("inside"), F.sum("odd").over(whole).alias("all"),
        F.max("first").over(whole).alias("first"))
    return found.select(
        "_file", "_block", "lines", "inside", "odd", (F.col("inside") | (F.col("odd") > 0) | (F.col("_block") == 0)).alias("ragged"),
        (F.col("all") > 0).alias("folded"), (F.col("all") % 2 == 1).alias("unclosed"),
        F.rtrim(F.ltrim("first", F.lit("\ufeff")), F.lit("\r")).alias("header"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """`df` written with its rows dealt by `key`, so that what groups by it needs
    no shuffle: compressed files of columns take far less disk."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, WRITERS)
    try:
        (df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet")
         .saveAsTable(table))
    finally:
        spark.conf.set(writers, before)
    written = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the entry; the files stay
    return written


def _records(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """(_file, _block, _row, record): the lines of `files` but for their first
    records, the headers; lines of one record joined again."""
    # where Spark splits files depends on all files of a scan: these alone, once more
    splits = _written(_splits(spark, files, encoding).withColumn("split", F.monotonically_increasing_id()), "csv-splits")
    lines = _lines(spark, files, encoding).join(
        F.broadcast(splits.select("_file", "_block", "split", "inside", "ragged")), ["_file", "_block"])  # one row a split
    whole = lines.filter("NOT ragged").select("_file", "_block", "_row", F.col("line").alias("record"))
    lines = _dealt(lines.filter("ragged").select("split", "_row", "line", "quotes", "inside"), "split",
                   min(BUCKETS * splits.filter("ragged").count(), MOST_BUCKETS), "csv-lines")

    # the record that a split begins within begins in the last split before that is not within it as a whole, at the
    # last line there that ends within quotes; it goes on up to the split's first such line
    odd = F.when(F.col("quotes") % 2 == 1, F.col("_row"))
    ends = lines.groupBy("split").agg(F.min(odd).alias("first"), F.max(odd).alias("last"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = F.col("inside") & (F.col("odd") == 0)
    ends = _written(splits.withColumn("owner", F.last(F.when(~within, F.col("split")), ignorenulls=True).over(earlier))
                    .join(ends, "split").select("split", "_file", "_block", "inside", "owner", "first", "last"), "csv-ends")
    heads = (lines.select("split", "_row", "line")
             .join(F.broadcast(ends.filter("inside").select("split", "_block", "owner", "first")), "split")
             .filter("first IS NULL OR _row <= first").groupBy(F.col("owner").alias("split"))
             .agg(F.array_sort(F.collect_list(F.struct("_block", "_row", "line"))).alias("l")))
    rest = _written(heads.join(ends.select("split", F.col("last").alias("_row")), "split").select(
        "split", "_row", F.array_join("l.line", "\n").alias("rest")), "csv-rest")

    here = Window.partitionBy("split").orderBy("_row")  # at most a split
    before = F.col("inside").cast("int") + F.coalesce(
        F.sum("quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("starts", (before % 2 == 0).cast("int"))
    numbered = numbered.withColumn("nth", F.sum("starts").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.filter("nth > 0").groupBy("split", "nth").agg(
        F.array_sort(F.collect_list(F.struct("_row", "line"))).alias("l"))
    joined = (joined.select("split", "nth", F.col("l")[0]["_row"].alias("_row"), F.array_join("l.line", "\n").alias("record"))
              .join(rest, ["split", "_row"], "left")
              .join(F.broadcast(ends.select("split", "_file", "_block")), "split").filter("_block > 0 OR nth > 1")
              .select("_file", "_block", "_row", F.concat_ws("\n", "record", "rest").alias("record")))
    return whole.unionByName(joined).withColumn("record", F.rtrim("record", F.lit("\r")))


def _fields(header: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in (*header, "_line")])


def _surplus(header: tuple[str, ...]) -> Column:
    """Only lines of another length than the header reach _line."""
    fields = F.size(F.split(F.regexp_replace("_line", '"([^"]|"")*"', ""), ",", -1))
    return F.coalesce(fields > len(header), F.lit(False)).alias("_surplus")


_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "emptyValue": ""}


def _parsed(records: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """The fields of whole records; blank ones go."""
    schema = ", ".join(f"`{f.name}` STRING" for f in _fields(header).fields)
    # a generator, so a record is parsed once, not once a reference to one of its fields
    fields = F.inline(F.array(F.from_csv("record", schema, _OPTIONS)))
    rows = records.filter(F.length("record") > 0).select("_file", "_block", "_row", fields)
    return rows.select(
        *[F.col(f"`{c}`") for c in header], _surplus(header), "_file", "_block", "_row")


def _text(spark: SparkSession, header: tuple[str, ...], files: list[str], multiline: bool,
          encoding: str) -> DataFrame:
    text = (spark.read.schema(_fields(header)).options(**_OPTIONS)
            .option("header", True).option("multiLine", multiline).option("encoding", encoding)
            .option("columnPruning", False).csv(files))
    return text.select(*[F.col(f"`{c}`").alias(c) for c in header], _surplus(header),
                       F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_row"))


def read_wide_csv(spark: SparkSession, path: str, na_tokens=PANDAS_NA_TOKENS,
                  multiline: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Read wide order-line CSV files as typed columns plus position and ``_bad``.

    ``multiline=True`` reads each file in one task instead, for encodings in
    which a quote or a line end is not the byte it is in ASCII.
    """
    # one row a file
    files = _splits(spark, path, encoding).filter(F.col("_block") == 0).select("_file", "header", "folded", "unclosed").collect()
    groups: dict[tuple, list[str]] = {}
    for name, line, folded, unclosed in sorted(files):
        if not line:  # an empty file has no rows
            continue
        if unclosed and not multiline:
            raise ValueError(f"{name} ends inside a quoted field")
        groups.setdefault((line, folded and not multiline), []).append(_as_path(name))
    if not groups:
        raise ValueError(f"no CSV file with a header under {path}")
    headers = {line: tuple(next(csv.reader([line]))) for line, _ in groups}
    for (line, _), names in groups.items():
        if len(set(headers[line])) < len(headers[line]):
            raise ValueError(f"repeated column names in the header of {names[0]}: {list(headers[line])}")
    if len(set(map(frozenset, headers.values()))) > 1:
        raise ValueError(f"the files under {path} name different columns: {sorted(map(sorted, headers.values()))}")
    parts = [_parsed(_records(spark, names, encoding), headers[line]) if folded
             else _text(spark, headers[line], names, multiline, encoding)
             for (line, folded), names in groups.items()]
    return typed_wide(reduce(DataFrame.unionByName, parts), na_tokens)
