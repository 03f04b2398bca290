"""Quality rules with adaptive thresholds (native).

Each document gets integer measures of its whole text.  Two base rules fail a
document outright; the rest of the verdict compares four ratios with fences
learned from the data: a mergeable quantile sketch per language and source
(counts per bucket, six significant bits per bucket, so a quantile is off by
at most 1/32 of its value) gives the quartiles q1 and q3, and a document
outside [q1 - 3 iqr - margin, q3 + 3 iqr + margin] is rejected.  Groups with
fewer than `min_rows` documents merge into their language's sketch, languages
with fewer into the sketch of all; the join then brings the fences back.

Everything is DataFrame work; the sketches are pre-aggregated counts, so a
source with a third of all rows is a few hundred bucket rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import common

SYMBOLS = "#*$%&|<>"
#: measure -> (margin above, margin below or None where low values are fine);
#: the ratios are in thousandths, the mean word length in hundredths.
MARGINS = {"symbols": (100, None), "dup_lines": (300, None),
           "repeats": (200, None), "word_length": (100, 100)}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text.

    Null text counts as empty (all zero); repeated rows are measured one by
    one; other input columns are ignored.  A window is identified inside its
    document by the 64-bit hash of its three words.
    """
    d = common.only(docs, doc_id="long", lang="string", source="string", text="string")
    t = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(t, common.WHITE, "")
    d = d.select("doc_id", "lang", "source",
                 common.words(t).alias("w"),
                 F.length(bare).cast("long").alias("word_chars"),
                 (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long")
                 .alias("n_symbols"),
                 F.filter(F.split(t, "\n"), lambda x: common.trimmed(x) != "").alias("lines"))
    d = d.select("doc_id", "lang", "source", "word_chars", "n_symbols",
                 F.size("w").cast("long").alias("n_words"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
                 .alias("n_dup_lines"),
                 F.expr("CASE WHEN size(w) < 3 THEN array() ELSE transform(sequence(0, size(w) - 3), "
                        "i -> xxhash64(w[i], w[i + 1], w[i + 2])) END").alias("h"))
    # the sorted (hash, position) pairs are built only where a window repeats
    d = d.withColumn("s", F.expr(
        "CASE WHEN size(array_distinct(h)) < size(h) "
        "THEN sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) END")).drop("h")
    d = d.withColumn("p", F.expr(
        "transform(filter(s, (e, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR "
        "(k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x)), e -> e.i)")).drop("s")
    return d.withColumn("n_repeat_words", F.expr(
        "CASE WHEN p IS NULL THEN 0L ELSE cast(size(array_union(array_union(p, "
        "transform(p, x -> x + 1)), transform(p, x -> x + 2))) AS BIGINT) END")).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    whole = lambda a, b: F.floor(a / b).cast("long")
    return {"symbols": whole(F.col("n_symbols") * 1000, n),
            "dup_lines": whole(F.col("n_dup_lines") * 1000,
                               F.greatest(F.col("n_lines"), F.lit(1))),
            "repeats": whole(F.col("n_repeat_words") * 1000, n),
            "word_length": whole(F.col("word_chars") * 100, n)}


def bucket(v: Column) -> Column:
    """The lower end of the value's bucket: its six leading bits kept."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketch(measured: DataFrame) -> DataFrame:
    """Mergeable sketches: lang, source, measure, bucket, n (documents that pass
    the base rules)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.col(k)).alias("bucket"))
                                for k in ratios()]))
    return (measured.filter(~F.col("base_failed")).select("lang", "source", pairs.alias("x"))
            .groupBy("lang", "source", "x.measure", "x.bucket")
            .agg(F.count(F.lit(1)).alias("n")))


def merged(sk: DataFrame, keys: list[str]) -> DataFrame:
    return sk.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure -> rows, q1, q3: the smallest buckets that reach a quarter
    and three quarters of the rows.  A window holds one group's buckets only."""
    w = Window.partitionBy(*keys, "measure")
    c = sk.select(*keys, "measure", "bucket",
                  F.sum("n").over(w.orderBy("bucket")).alias("upto"),
                  F.sum("n").over(w).alias("rows"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, F.col("bucket")))
    return c.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"),
                                           at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sk: DataFrame, min_rows: int = 50) -> DataFrame:
    """lang, source, measure, low, high for every group in the sketch."""
    own = quartiles(sk, ["lang", "source"])
    by_lang = quartiles(merged(sk, ["lang"]), ["lang"]).select(
        F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"),
        F.struct("rows", "q1", "q3").alias("l"))
    everything = quartiles(merged(sk, []), []).select(
        F.col("measure").alias("a_measure"), F.struct("rows", "q1", "q3").alias("a"))
    t = own.join(by_lang, own.lang.eqNullSafe(F.col("l_lang"))
                 & (own.measure == F.col("l_measure")))
    t = t.join(F.broadcast(everything), F.col("measure") == F.col("a_measure"))  # one row a measure
    q = (F.when(F.col("rows") >= min_rows, F.struct("rows", "q1", "q3"))
         .when(F.col("l.rows") >= min_rows, F.col("l")).otherwise(F.col("a")))
    t = t.select("lang", "source", "measure", q.alias("q"))
    up = F.create_map(*[F.lit(x) for k, (hi, _) in MARGINS.items() for x in (k, hi)])
    down = F.create_map(*[F.lit(x) for k, (_, lo) in MARGINS.items()
                          for x in (k, -1 if lo is None else lo)])
    iqr = F.col("q.q3") - F.col("q.q1")
    return t.select("lang", "source", "measure",
                    F.when(down[F.col("measure")] >= 0,
                           F.col("q.q1") - iqr * 3 - down[F.col("measure")]).alias("low"),
                    (F.col("q.q3") + iqr * 3 + up[F.col("measure")]).alias("high"))


def judge(docs: DataFrame, min_rows: int = 50) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed and kept.

    Null languages and sources form groups of their own.  An empty table gives
    an empty result.  The measures are written once to the checkpoint folder
    and read for the sketches and for the verdict.
    """
    m = measures(docs)
    m = m.withColumn("base_failed", base_failed()).withColumns(ratios())
    m = common.cut(m, "quality")
    wide = (thresholds(sketch(m), min_rows)
            .groupBy("lang", "source")
            .agg(*[F.max(F.when(F.col("measure") == k, F.col(e))).alias(f"{k}_{e}")
                   for k in ratios() for e in ("low", "high")])
            .withColumnsRenamed({"lang": "t_lang", "source": "t_source"}))
    j = m.join(wide, m.lang.eqNullSafe(wide.t_lang) & m.source.eqNullSafe(wide.t_source), "left")
    inside = F.lit(True)
    for k in ratios():
        inside = inside & F.coalesce(F.col(k) >= F.col(f"{k}_low"), F.lit(True)) \
            & F.coalesce(F.col(k) <= F.col(f"{k}_high"), F.lit(True))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & inside).alias("kept"))
