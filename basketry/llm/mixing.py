"""Mixing sources to target weights by Poisson replication (native).

Every document of source s is repeated a Poisson-distributed number of times
whose mean is the source's target repetition rate

    rate(s) = target share(s) * total characters / characters of s

The count inverts the Poisson distribution at a number in [0, 1) hashed from
the seed and the document id, so a rerun or a retried task makes the same
copies.  Copies are exploded and the whole result is shuffled by a hash of
(id, copy) and sorted by it inside each partition: a global random order that
no source can skew, since every copy has its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common

#: Poisson means above this are drawn as sums of equal independent parts, as
#: exp(-mean) would lose precision.
PART = 200.0
#: Sources up to this many rows of (name, rate, table) are broadcast; beyond
#: it the rates are joined by source, where skewed sources are split by AQE.
BROADCAST_SOURCES = 5_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts' text."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def sizes(docs: DataFrame) -> DataFrame:
    """source -> chars: characters of all its texts (null text counts zero)."""
    d = common.only(docs, source="string", text="string")
    return d.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


def rates(sizes: DataFrame, weights: dict[str, float] | None = None,
          temperature: float = 2.0, total: float | None = None) -> DataFrame:
    """source -> rate, parts, cdf.

    `weights` names target weights (sources it leaves out get none and vanish);
    without it a source weighs chars ** (1 / temperature).  `total` is the
    number of characters wanted, by default as many as there are.  A source
    without any character has rate 1.  `cdf` holds the distribution function
    of one part from 0 up to where less than 2**-53 remains.
    """
    if weights is None:
        w = F.pow(F.col("chars").cast("double"), F.lit(1.0 / temperature))
    elif weights:
        m = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        w = F.coalesce(F.element_at(m, F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0))
    else:
        raise ValueError("weights is empty")
    s = sizes.select("source", F.col("chars").cast("double").alias("chars"), w.alias("w"))
    s = s.withColumn("w", F.when(F.col("chars") > 0, F.col("w")).otherwise(0.0))
    all_w, all_chars = s.agg(F.sum("w"), F.sum("chars")).first()
    want = float(total) if total is not None else (all_chars or 0.0)
    rate = (F.when(F.col("chars") == 0, F.lit(1.0))
            .otherwise(F.col("w") / F.lit(all_w or 1.0) * F.lit(want) / F.col("chars")))
    s = s.select("source", rate.alias("rate"))
    s = s.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    s = s.withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 30).cast("int")
    # running product and running sum: p(k) = p(k-1) * mean / k
    return s.withColumn("last", last).select("source", "rate", "parts", F.expr(
        "aggregate(sequence(1, last), named_struct('p', exp(-mean), 'c', exp(-mean), "
        "'cdf', array(exp(-mean))), (a, k) -> named_struct('p', a.p * mean / k, "
        "'c', a.c + a.p * mean / k, 'cdf', concat(a.cdf, array(a.c + a.p * mean / k))), "
        "a -> a.cdf)").alias("cdf"))


def drawn(docs: DataFrame, weights: dict[str, float] | None, temperature: float,
          total: float | None, seed: int) -> DataFrame:
    """The copies in their global random order: the input's columns, _mix_n,
    _mix_copy and _mix_key."""
    r = rates(common.cut(sizes(docs), "mix-sizes"), weights, temperature, total)
    r = common.cut(r, "mix-rates")
    r = r.select(F.col("source").alias("_mix_source"), F.col("parts").alias("_mix_parts"),
                 F.col("cdf").alias("_mix_cdf"))
    if r.count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    j = docs.join(r, F.col("`source`").cast("string").eqNullSafe(F.col("_mix_source")))
    id_ = F.col("`doc_id`").cast("long")
    # one draw per part: how many steps of the distribution lie at or below u
    u = lambda part: unit(F.lit(seed), id_, part)
    first = u(F.lit(1))
    j = j.withColumn("_mix_u", first)
    more = F.when(F.col("_mix_parts") > 1, F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.col("_mix_parts"), F.lit(2))), F.lit(0),
        lambda a, part: a + F.size(F.filter("_mix_cdf", lambda c: u(part) >= c)))).otherwise(0)
    n = F.size(F.filter("_mix_cdf", lambda c: F.col("_mix_u") >= c)) + more
    j = j.withColumn("_mix_n", n).filter("_mix_n > 0")
    j = j.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(
        id_.cast("string"), F.lit("null")), F.col("_mix_copy")).cast("binary")), 1, 16)
    j = j.withColumn("_mix_key", key).select(
        *[F.col(f"`{c}`") for c in docs.columns], "_mix_n", "_mix_copy", "_mix_key")
    # rows that share an id share a key: the other columns tell where they go
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    return j.repartition("_mix_key", row).sortWithinPartitions("_mix_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0,
        total: float | None = None, seed: int = 17) -> DataFrame:
    """The input's columns, then n_copies, copy (1..n_copies) and shuffle_key.

    Rows with a null id share the hash of the word null, repeated rows of one
    id share that id's count; the row decides which task they go to.  Texts are
    carried whole, whatever their length.  Null sources are a source of their own.  An
    empty table gives an empty result; input columns named like the added ones
    are replaced.
    """
    out = common.replace_columns(drawn(docs, weights, temperature, total, seed),
                                 n_copies=F.col("_mix_n"), copy=F.col("_mix_copy"),
                                 shuffle_key=F.col("_mix_key"))
    return out.drop("_mix_n", "_mix_copy", "_mix_key")


def repeated(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0,
             total: float | None = None, seed: int = 17) -> DataFrame:
    """As `mix`, with the input's columns only, all as they are."""
    return drawn(docs, weights, temperature, total, seed).drop("_mix_n", "_mix_copy", "_mix_key")
