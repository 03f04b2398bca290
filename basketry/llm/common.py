"""Helpers shared by the operators: column selection, words, folds, lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import drop_scratch, scratch_path

#: The white space that separates words, as the bytes \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def only(df: DataFrame, **casts: str) -> DataFrame:
    """The named columns cast to the given types, and no others, so extra input
    columns (whatever their names) never meet an operator's own."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in casts.items()])


def position(df: DataFrame, name: str) -> int:
    """The place of a column: of the very name, else of one that differs in case."""
    return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null or blank text."""
    t = trimmed(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(t, WHITE_CLASS + "+"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


#: Rows of one Arrow batch to a Python worker; texts are long, so far fewer
#: than Spark's default of 10,000.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's Arrow batches limited to BATCH_ROWS rows (a
    smaller setting is left alone): a batch of whole texts is held in the
    executor and in the worker at once, so its size bounds their memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def cut(df: DataFrame, name: str, tasks: int | None = None, rows: int = 0) -> DataFrame:
    """Write `df` to a fresh folder in the shared checkpoint directory and read
    it back: lineage ends there, and a lost executor costs only its tasks.  With
    `tasks` its last stage has no more than so many, with `rows` a file has no
    more than so many: Parquet's writer holds 100 rows before it looks at their
    size."""
    if tasks:
        df = df.coalesce(tasks)
    path = scratch_path(df.sparkSession, f"llm-{name}")
    (df.write.option("maxRecordsPerFile", rows) if rows else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove the folders of frames that `cut` returned and nothing reads any more."""
    for df in frames:
        drop_scratch(df.sparkSession, df.scratch_folder)


def replace_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add the columns last; input columns of the same names (in any case) go."""
    taken = {c.lower() for c in columns}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, *[v.alias(k) for k, v in columns.items()])


def slices(batch, column: int, chars: int, rows: int = 128):
    """(slice of an Arrow batch, its texts) with about `chars` characters each;
    null texts come as empty ones.  Texts become Python strings `rows` at a
    time, so a large batch is never held twice."""
    start, texts, held = 0, [], 0
    for i in range(0, batch.num_rows, rows):
        for t in batch.column(column).slice(i, rows).to_pylist():
            texts.append(t or "")
            held += len(texts[-1])
            if held >= chars:
                yield batch.slice(start, len(texts)), texts
                start, texts, held = start + len(texts), [], 0
    if texts:
        yield batch.slice(start), texts
