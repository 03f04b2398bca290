"""Which renames of a change set are refused, settled in rounds.

A rename is refused if another id holds its name when its turn comes, and
whether it does depends on earlier renames.  Most requests need no turn: a name
that a single id holds or asks for is granted whatever the order, and ids that
never touch a contested name play no part.  The others are settled together:

* a guess says which requests are granted: of each free name the first that
  asks for it, for good;
* a round judges every request by the guess at once: per id a running "last
  granted name", per name a running sum of takers and leavers;
* requests before the first one that the round judges otherwise depend on right
  guesses only, so they are settled, and that one with them.  The round's
  verdict is the next guess; where rounds come no nearer, the settled
  beginning is put away and the guess is made anew from the names held then.

A round without a change is the outcome of one request after the other.  Every
fresh guess settles a longer beginning, so rounds end; there are as many as
name changes depend on each other in ways the guess does not foresee (1 to 7
for the registered change sets of up to 20,000 requests, whatever the share of
contested ones).

A frame with a row a request is never broadcast: its files are small for what
they hold (a few names, rising numbers), so joins with it name the sort-merge join.

Running values go over slices of the request order with a carry from slice to
slice, so neither an id nor a name with a third of all requests is one window.
Each round ends in a written table; a count and a minimum reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import drop_scratch, release, scratch_path

#: Requests of one slice, about; more slices than MOST are not made, larger ones are.
SLICE, MOST = 200_000, 256


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "settle")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _sliced(requests: DataFrame) -> tuple[DataFrame, int]:
    """`requests` with the number of their slice of the seq order; the slices."""
    n = requests.count()
    parts = min(MOST, 1 + n // SLICE)
    if parts == 1:
        return requests.withColumn("slice", F.lit(0)), 1
    bounds = requests.agg(F.percentile_approx("seq", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    before = F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col("seq"))
    return requests.withColumn("slice", F.size(before)), parts


def _before(*keys: str):
    return Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _borne_before(requests: DataFrame, holders: DataFrame, slices: int) -> DataFrame:
    """(id, slice, _borne): the name an id bears when a slice begins."""
    if slices == 1:
        return holders.select("id", F.lit(0).alias("slice"), F.col("name").alias("_borne"))
    last = requests.groupBy("id", "slice").agg(F.max_by("name", F.when(F.col("granted"), F.col("seq"))).alias("_last"))
    return last.join(holders.withColumnRenamed("name", "_held"), "id", "left").select(
        "id", "slice", F.coalesce(F.last("_last", True).over(_before("id").orderBy("slice")), "_held").alias("_borne"))


def _held_before(steps: DataFrame, holders: DataFrame, slices: int) -> DataFrame:
    """(name, slice, _carried): how many ids bear a name when a slice begins."""
    held = holders.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    if slices == 1:
        return held.select("name", F.lit(0).alias("slice"), F.col("_n").alias("_carried"))
    sums = steps.groupBy("name", "slice").agg(F.sum("delta").alias("_n")).unionByName(
        held.select("name", F.lit(-1).alias("slice"), "_n"))
    return sums.select("name", "slice", F.sum("_n").over(_before("name").orderBy("slice")).alias("_carried"))


def _judge(requests: DataFrame, holders: DataFrame, slices: int) -> DataFrame:
    """`requests` with `granted` as it follows from the guess in `granted`, and
    the guess as `was`."""
    # the name an id bears when its turn comes, if the guess is right
    own = F.last(F.when(F.col("granted"), F.col("name")), True).over(_before("id", "slice").orderBy("seq"))
    turns = requests.withColumn("_own", own).hint("merge").join(
        _borne_before(requests, holders, slices), ["id", "slice"]).withColumn(
        "_own", F.coalesce("_own", "_borne")).drop("_borne")
    moves = F.col("granted") & (F.col("_own") != F.col("name"))
    # holders of a name: takers so far less leavers
    asked = turns.withColumn("delta", moves.cast("int"))
    left = turns.filter(moves).select(F.col("_own").alias("name"), "slice", "seq", F.lit(-1).alias("delta"))
    steps = asked.unionByName(left, allowMissingColumns=True)
    here = F.coalesce(F.sum("delta").over(_before("name", "slice").orderBy("seq")), F.lit(0))
    judged = steps.withColumn("_here", here).filter(F.col("id").isNotNull()).join(
        _held_before(steps, holders, slices).hint("merge"), ["name", "slice"], "left")
    others = F.col("_here") + F.coalesce("_carried", F.lit(0)) - (F.col("_own") == F.col("name")).cast("int")
    return judged.select("seq", "slice", "id", "name", "contested", F.col("granted").alias("was"),
                         (~F.col("contested") | (others <= 0)).alias("granted"))


def _guess(requests: DataFrame, holders: DataFrame) -> DataFrame:
    """`requests` with `granted`: the holder of a name keeps it, a free one goes
    to the first that asks; uncontested names are granted."""
    first = requests.filter("contested").groupBy("name").agg(F.min_by("id", "seq").alias("_first"))
    held = holders.groupBy("name").agg(F.min("id").alias("_holder"))
    keeper = first.join(held, "name", "left").select("name", F.coalesce("_holder", "_first").alias("_keeper"))
    return requests.drop("granted", "was").join(keeper, "name", "left").select(
        "seq", "slice", "id", "name", "contested", (~F.col("contested") | (F.col("id") == F.col("_keeper")))
        .alias("granted"))


def refused_renames(current: DataFrame, valid: DataFrame) -> DataFrame:
    """(refused): the `seq` of the requests in `valid` (seq, _id, _name) whose
    name another id holds when their turn comes; `current` (_id, _name) holds
    the names before the first request."""
    spark = current.sparkSession
    claims = current.select("_id", "_name").union(valid.select("_id", "_name"))
    contested = claims.groupBy("_name").agg(F.min("_id").alias("a"), F.max("_id").alias("z")).filter("a <> z").select(
        "_name", F.lit(True).alias("contested"))
    involved = claims.join(contested, "_name", "left_semi").select("_id").distinct()
    holders, path = _written(current.join(involved, "_id", "left_semi").select(
        F.col("_id").alias("id"), F.col("_name").alias("name")))
    paths = [path]
    requests = valid.join(involved, "_id", "left_semi").join(contested, "_name", "left").select(
        F.col("seq").cast("bigint").alias("seq"), F.col("_id").alias("id"), F.col("_name").alias("name"),
        F.coalesce("contested", F.lit(False)).alias("contested"))
    requests, path = _written(requests)
    paths.append(path)
    requests, slices = _sliced(requests)
    state, path = _written(_guess(requests, holders))
    paths.append(path)
    settled, least = [], None
    while True:
        state, path = _written(_judge(state, holders, slices))
        paths.append(path)
        if len(paths) % 8 == 0:
            release(spark)
        changes, first = state.filter("granted <> was").agg(F.count(F.lit(1)), F.min("seq")).first()
        if not changes:
            break
        if least is not None and changes >= least:
            done = state.filter(F.col("seq") <= first)
            settled.append(done)
            now = done.filter("granted").groupBy("id").agg(F.max_by("name", "seq").alias("_now"))
            holders, path = _written(holders.join(now, "id", "left").select("id", F.coalesce("_now", "name")
                                                                            .alias("name")))
            paths.append(path)
            state, path = _written(_guess(state.filter(F.col("seq") > first), holders))
            paths.append(path)
            least = None
        else:
            least = changes
    parts = [s.filter("NOT granted").select(F.col("seq").alias("refused")) for s in [*settled, state]]
    out, _ = _written(reduce(DataFrame.unionByName, parts))
    for path in paths:  # the outcome is written, the rounds are not read again
        drop_scratch(spark, path)
    return out
