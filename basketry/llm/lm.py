"""LM scoring by cross-entropy difference.

Two n-gram models of order 4 over one vocabulary (the 256 byte values, so
nothing is unknown to either) are counted over all documents: one from the
target documents, one from the rest, the background.  They are matched: same
vocabulary, order and smoothing, and the background's counts are scaled to the
target's number of tokens, so neither gains from having seen more text.  A
document's score is the mean per-token loss difference, target minus
background, over its whole text: the lower, the more like the target.

Every n-gram is counted exactly.  One of length 4 is its own 32-bit key, and the
counts of lengths 1 to 3 are sums of those of length 4 by their last bytes, so
the models are one grouped table (gram, t, b) that grows with the distinct
n-grams of the corpus.  Counting sums within a task first; the table is written
to the checkpoint folder.  A token's losses depend on its 4-gram alone.  Up to
BROADCAST_GRAMS counted rows the table travels to the tasks and texts are scored
where they are; beyond that the distinct n-grams of the texts are joined with
the table and the losses summed per document.  Both ways score alike.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common

#: Bits of a 4-gram's key: its four bytes, so no two n-grams share one.
BITS = 32
ALPHA = 4.0
#: Rows of counts by n-grams of length 1 and 2, which a model always holds.
SIZE = 256 + 65536
#: Target ids that are broadcast (8 bytes each); beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: Counted 4-grams that travel to the tasks (about 40 bytes each); beyond it
#: they are joined.
BROADCAST_GRAMS = 2_000_000
#: Bytes that are counted or scored together.
CHUNK = 1 << 20
#: Distinct n-grams that a task holds before it hands its counts on.
HELD = 1_000_000


def grams(data: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each position, as a number; the text is led in by
    three zero bytes."""
    x = np.concatenate((np.zeros(3, np.uint32), data.astype(np.uint32)))
    return (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


def chunks(text: str):
    """The text's bytes in chunks, each after the first with its last three
    predecessors: (bytes, how many of them are context)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    for i in range(0, len(raw), CHUNK):
        k = min(i, 3)
        yield raw[i - k:i + CHUNK], k


class Tally:
    """Counts of 64-bit keys: those of the last CHUNK or so as they came, the
    others summed."""

    def __init__(self):
        self.new, self.size = [], 0
        self.keys, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray):
        self.new.append(keys)
        self.size += len(keys)
        if self.size >= CHUNK:
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys in order, how often each came)."""
        if self.new:
            keys, times = np.unique(np.concatenate(self.new), return_counts=True)
            self.new, self.size = [], 0
            if len(self.keys):
                every = np.concatenate((self.keys, keys))
                order = np.argsort(every, kind="stable")
                every, times = every[order], np.concatenate((self.times, times))[order]
                first = np.flatnonzero(np.diff(every, prepend=every[0] - 1))
                keys, times = every[first], np.add.reduceat(times, first)
            self.keys, self.times = keys, times
        return self.keys, self.times


def count(docs: DataFrame) -> DataFrame:
    """(is_target, text) -> gram, t, b: counts in target and background of every
    4-gram."""
    def rows(tally):
        keys, times = tally.sum()
        gram, background = keys >> 1, keys & 1
        for i in range(0, len(gram), 100_000):
            n, b = times[i:i + 100_000], background[i:i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[i:i + 100_000]), pa.array(n * (1 - b)), pa.array(n * b)],
                names=["gram", "t", "b"])

    def run(batches):
        tally = Tally()
        for batch in batches:
            for piece, texts in common.slices(batch, 1, CHUNK):
                for target, text in zip(piece.column(0).to_pylist(), texts):
                    for data, k in chunks(text):
                        tally.add(grams(data)[k:].astype(np.int64) << 1 | (not target))
                        if len(tally.keys) >= HELD:
                            yield from rows(tally)
                            tally = Tally()
        yield from rows(tally)

    parts = common.small_batches(docs.select("is_target", "text")).mapInArrow(run, "gram long, t long, b long")
    return parts.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    some, at = np.unique(keys, return_inverse=True)
    return some, np.stack([np.bincount(at, c, len(some)) for c in counts.T], axis=1)


class Counts:
    """Sorted n-grams of one length and their counts (n-gram, 2)."""

    def __init__(self, keys: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.keys = np.empty(0, np.uint32) if keys is None else keys.astype(np.uint32)
        self.counts = np.empty((0, 2)) if counts is None else counts.astype(np.float64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def of(self, keys: np.ndarray) -> np.ndarray:
        at, there = self.find(keys)
        out = np.zeros((len(keys), 2))
        out[there] = self.counts[at[there]]
        return out


class Model:
    """Both models' counts by n-grams of length 1 and 2 (rows of `counts`), and
    3 and 4 where they are held here; `table` has them (gram, t, b) otherwise."""

    def __init__(self, counts: np.ndarray, three: Counts | None = None, four: Counts | None = None):
        tokens = counts[:256].sum(axis=0)
        # matched size
        self.scale = np.array([1.0, tokens[0] / tokens[1] if tokens.min() > 0 else 1.0])
        n = counts * self.scale
        one = (n[:256] + ALPHA / 256) / (n[:256].sum(axis=0) + ALPHA)
        context = n[256:].reshape(256, 256, 2)
        two = (context + ALPHA * one[None]) / (context.sum(axis=1)[:, None] + ALPHA)
        self.two, self.pairs = two.reshape(-1, 2), n[256:]
        self.three, self.four = three or Counts(), four or Counts()
        self.table: DataFrame | None = None
        keys = self.four.keys
        self.known = self.loss(keys, self.four.counts, self.three.of(keys & 0xFFFFFF), self.three.of(keys >> 8))

    def loss(self, gram: np.ndarray, n4: np.ndarray, n3: np.ndarray, c3: np.ndarray) -> np.ndarray:
        """Losses (target, background) of each 4-gram's last byte, from its
        count, that of its last three bytes and that of its first three."""
        n4, n3, c3 = n4 * self.scale, n3 * self.scale, c3 * self.scale
        c2 = self.pairs[gram >> 8 & 0xFFFF]
        p = (np.minimum(n3, c2) + ALPHA * self.two[gram & 0xFFFF]) / (c2 + ALPHA)
        p = (np.minimum(n4, c3) + ALPHA * p) / (c3 + ALPHA)
        return -np.log(p)

    def losses(self, data: np.ndarray, k: int) -> np.ndarray:
        """Summed losses (target, background) of the bytes from the k-th on."""
        g = grams(data)[k:]
        at, there = self.four.find(g)
        if there.all():
            return self.known[at].sum(axis=0)
        new = g[~there]
        fresh = self.loss(new, np.zeros((len(new), 2)), self.three.of(new & 0xFFFFFF), self.three.of(new >> 8))
        return self.known[at[there]].sum(axis=0) + fresh.sum(axis=0)


def fit(docs: DataFrame) -> Model:
    """Counts over all rows of (is_target, text).  At most BROADCAST_GRAMS rows
    are collected, of a larger table only the sums by pairs of bytes."""
    table = common.cut(count(docs), "lm-grams")
    small = table.count() <= BROADCAST_GRAMS
    got = (table if small else table.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram"))
           .agg(F.sum("t").alias("t"), F.sum("b").alias("b"))).toArrow()
    key = got.column("gram").to_numpy()
    n = np.stack((got.column("t").to_numpy(), got.column("b").to_numpy()), axis=1)
    counts = np.zeros((SIZE, 2))
    for length, start in ((1, 0), (2, 256)):
        some, sums = summed(key & (256**length - 1), n)
        counts[some + start] = sums
    if small:
        order = np.argsort(key)
        return Model(counts, Counts(*summed(key & 0xFFFFFF, n)), Counts(key[order], n[order]))
    model = Model(counts)
    model.table = table
    return model


RESULT = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, n_tokens, loss_target, loss_background
    (means per token) and score, their difference.

    Null and empty texts have no tokens, null losses and score 0.  Repeated
    rows are scored one by one; extra columns are ignored; an empty table
    gives an empty result.
    """
    docs = common.small_batches(common.only(docs, doc_id="long", text="string"))
    if model.table is not None:
        return joined(docs, model)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for batch in batches:
            for piece, texts in common.slices(batch, 1, CHUNK):
                rows = []
                for text in texts:
                    total, n = np.zeros(2), 0
                    for data, k in chunks(text):
                        total += m.losses(data, k)
                        n += len(data) - k
                    t, b = (total / n).tolist() if n else (None, None)
                    rows.append((n, t, b, t - b if n else 0.0))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(cols[0], pa.int64()),
                     *[pa.array(c, pa.float64()) for c in cols[1:]]],
                    names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return docs.mapInArrow(run, RESULT)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> piece, gram, found: one row per distinct 4-gram of about
    CHUNK characters of texts, with the rows that hold it and how often.  A row
    without tokens stands under a null gram."""
    def run(batches):
        part, pieces = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece, texts in common.slices(batch, 1, CHUNK):
                tally, blank = Tally(), []
                for i, text in enumerate(texts):
                    for data, k in chunks(text):
                        tally.add(grams(data)[k:].astype(np.int64) << 31 | i)
                    if not text:
                        blank.append(i)
                keys, times = tally.sum()
                gram, row = keys >> 31, keys & 0x7FFFFFFF
                first = np.flatnonzero(np.diff(gram, prepend=-1))
                starts = [0, len(blank), *(first[1:] + len(blank)).tolist(), len(blank) + len(gram)]
                rows = np.concatenate((np.array(blank, np.int64), row))
                found = pa.StructArray.from_arrays(
                    [pa.array(rows.astype(np.int32)), piece.column(0).take(pa.array(rows)),
                     pa.array(np.concatenate((np.zeros(len(blank), np.int64), times)))],
                    names=["row", "doc_id", "n"])
                if not len(gram):
                    starts = [0, len(blank)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts) - 1, part << 32 | pieces)),
                     pa.array([None, *gram[first].tolist()], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(starts, pa.int32()), found)],
                    names=["piece", "gram", "found"])
                pieces += 1

    return docs.mapInArrow(run, "piece long, gram long, found array<struct<row:int,doc_id:long,n:long>>")


def loss_table(used: DataFrame, model: Model) -> DataFrame:
    """(gram) -> gram, lt, lb, from the counts in the model's table; n-grams that
    are not there count 0."""
    bare = copy.copy(model)
    bare.table = None  # a DataFrame does not travel
    shipped = used.sparkSession.sparkContext.broadcast(bare)
    three = (model.table.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("three"))
             .agg(F.sum("t").alias("t"), F.sum("b").alias("b")))
    named = lambda key, n: three.select(F.col("three").alias(key), F.col("t").alias(f"t{n}"),
                                        F.col("b").alias(f"b{n}"))
    rows = (used.join(model.table, "gram", "left")
            .withColumn("last", F.col("gram").bitwiseAND(0xFFFFFF))
            .withColumn("first", F.shiftright("gram", 8))
            .join(named("last", 3), "last", "left").join(named("first", 0), "first", "left")
            .select("gram", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "b", "t3", "b3", "t0", "b0")]))

    def run(batches):
        m = shipped.value
        for batch in batches:
            gram, *n = [c.to_numpy() for c in batch.columns]
            loss = m.loss(gram, *[np.stack(n[i:i + 2], axis=1) for i in (0, 2, 4)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(loss[:, 0]), pa.array(loss[:, 1])], names=["gram", "lt", "lb"])

    return rows.mapInArrow(run, "gram long, lt double, lb double")


def joined(docs: DataFrame, model: Model) -> DataFrame:
    """`score` by joins: nothing that grows with the n-grams is collected or held
    by a task."""
    found = occurrences(docs)
    used = found.filter("gram IS NOT NULL").select("gram").distinct()
    loss = common.cut(loss_table(used, model), "lm-losses")
    n = F.col("x.n")
    return (found.join(loss, "gram", "left").select("piece", "lt", "lb", F.explode("found").alias("x"))
            .groupBy("piece", F.col("x.row").alias("row"))
            .agg(F.first("x.doc_id").alias("doc_id"), F.sum(n).alias("n_tokens"),
                 F.sum(n * F.col("lt")).alias("lt"), F.sum(n * F.col("lb")).alias("lb"))
            .select("doc_id", "n_tokens", (F.col("lt") / F.col("n_tokens")).alias("loss_target"),
                    (F.col("lb") / F.col("n_tokens")).alias("loss_background"))
            .withColumn("score", F.coalesce(F.col("loss_target") - F.col("loss_background"), F.lit(0.0))))


def difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Score all documents against the target: the documents whose doc_id is in
    `target`.  Rows with a null id are background."""
    t = (common.only(target, doc_id="long").filter("doc_id IS NOT NULL").distinct()
         .withColumnRenamed("doc_id", "target_id"))
    t = common.cut(t, "lm-target")
    if t.count() <= BROADCAST_IDS:
        t = F.broadcast(t)
    d = common.only(docs, doc_id="long", text="string")
    marked = d.join(t, F.col("doc_id") == F.col("target_id"), "left").select(
        F.col("target_id").isNotNull().alias("is_target"), "text")
    return score(docs, fit(marked))
