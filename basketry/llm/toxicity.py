"""Toxicity by votes of the nearest labelled texts.

Terms are words and their beginnings of three to eight characters.  A bounded sample
of labelled texts (at most about PER_CLASS of each class, by a hash of the id)
gives the vocabulary (terms that go with toxic texts far beyond chance), inverse
document frequencies, and the examples.  A text's TF-IDF vector is compared by
exact cosine with every example through a block-max inverted index: examples
stand in blocks, each term stores the largest weight it has in a block, blocks
are visited by falling upper bound, and the visit ends when no bound can reach
the K-th best cosine.  The K nearest vote, weighted by cosine and class size, against the class shares;
a logistic curve fitted to the examples' leave-one-out votes calibrates the
score, and the nearest examples are returned as evidence.

Fitting is bounded by the sample; scoring is row-wise over whole texts, with
the index (bounded by the sample and the vocabulary) shipped to the tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common
from basketry.llm.jaccard import Words, node_of, shingles

#: Labelled texts per class, terms kept, and how far beyond chance (standard
#: deviations) a term's share must be larger among toxic texts.
PER_CLASS, VOCABULARY, BEYOND, LEAST = 3_000, 400, 5.0, 5
K, BLOCK = 25, 256
#: And how many times larger that share must be than among the others.
LIFT = 3
#: A neighbour counts by its cosine to this power; the class shares count like
#: a neighbour of cosine one half.
POWER = 4
PRIOR = 0.5**POWER
WORD = re.compile(r"\w+")


def terms_of(word: str) -> tuple[str, ...]:
    """A lower-case word's terms: itself, and its start with a mark."""
    return tuple([word, *(word[:n] + "*" for n in range(3, 9) if len(word) > n)])


class Terms(dict):
    """word -> numbers of its vocabulary terms; remembers up to LIMIT words."""

    LIMIT = 250_000

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple([self.number[t] for t in terms_of(word) if t in self.number])
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found
        return found


class Index:
    """Examples (distinct unit vectors as {term: weight}) in blocks, by term;
    `times` says how many labelled texts share a vector.

    A block keeps its terms' weights as rows over its examples; `top` holds a
    term's largest weight in each block, `row` its row there (-1: none)."""

    def __init__(self, vectors: list[dict[int, float]], times: np.ndarray):
        self.times = times
        self.number = {t: i for i, t in enumerate(sorted({t for v in vectors for t in v}))}
        blocks = range(0, len(vectors), BLOCK)
        self.top = np.zeros((len(self.number), len(blocks)))
        self.row = np.full((len(self.number), len(blocks)), -1)
        self.weights = []
        for b, start in enumerate(blocks):
            part = vectors[start:start + BLOCK]
            terms = sorted({t for v in part for t in v})
            at = {t: r for r, t in enumerate(terms)}
            weights = np.zeros((len(terms), len(part)))
            for i, v in enumerate(part):
                for t, w in v.items():
                    weights[at[t], i] = w
            self.weights.append(weights)
            if terms:
                rows = [self.number[t] for t in terms]
                self.row[rows, b] = np.arange(len(terms))
                self.top[rows, b] = weights.max(axis=1)

    def nearest(self, query: dict[int, float], k: int, times: np.ndarray | None = None):
        """The examples (places, cosines) of the k labelled texts of largest
        positive cosine, with all that tie with the k-th."""
        times = self.times if times is None else times
        live = [(self.number[t], w) for t, w in query.items() if t in self.number]
        places, cosines, least = np.empty(0, int), np.empty(0), 0.0
        if not live:
            return places, cosines
        terms, weight = np.array([t for t, _ in live]), np.array([w for _, w in live])
        bound = weight @ self.top[terms]
        rows = self.row[terms]
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or bound[b] < least - 1e-9:
                break
            held = rows[:, b] >= 0
            score = weight[held] @ self.weights[b][rows[held, b]]
            got = np.flatnonzero(score > max(0.0, least - 1e-9))
            got = got[times[got + b * BLOCK] > 0]
            if not len(got):
                continue
            places = np.concatenate((places, got + b * BLOCK))
            cosines = np.concatenate((cosines, score[got]))
            order = np.lexsort((places, -cosines))
            places, cosines = places[order], cosines[order]
            upto = np.cumsum(times[places])
            if upto[-1] >= k:
                least = cosines[np.searchsorted(upto, k)]
                keep = cosines >= least - 1e-9
                places, cosines = places[keep], cosines[keep]
        return places, cosines


class Model:
    def __init__(self, number: dict[str, int], idf: np.ndarray, ids: list[int],
                 toxic: list[int], counts: list[dict[int, int]], share: float):
        """share: of toxic rows among all labelled rows; the examples are a
        sample with another balance, which their weights undo."""
        self.number, self.idf, self.share = number, idf, share
        examples: dict[frozenset, list] = {}
        for i, y, c in zip(ids, toxic, counts):
            e = examples.setdefault(frozenset(c.items()), [[0, 0], []])
            e[0][y] += 1
            e[1].append(i)
        # alike examples side by side, by their heaviest terms, for tight blocks
        weights = {k: self.vector(dict(k)) for k in examples}
        kinds = sorted(examples, key=lambda k: [t for _, t in sorted(
            (-w, t) for t, w in weights[k].items())])
        self.texts = np.array([examples[k][0] for k in kinds], int).reshape(-1, 2)
        self.ids = [sorted(examples[k][1])[:3] for k in kinds]
        vectors = [weights[k] for k in kinds]
        total = np.maximum(1, self.texts.sum(axis=0))
        self.weight = np.array([1 - share, share]) / total * total.sum()
        self.index = Index(vectors, self.texts.sum(axis=1))
        votes, toxics, weights = [], [], []
        lone = np.zeros(2)
        for i, v in enumerate(vectors):
            for y in (0, 1):  # an example is not its own neighbour
                if not self.texts[i, y]:
                    continue
                self.texts[i, y] -= 1
                vote = self.vote(*self.index.nearest(v, K, self.texts.sum(axis=1)))
                self.texts[i, y] += 1
                w = self.weight[y] * self.texts[i, y]
                if vote is None:
                    lone[y] += w
                else:
                    votes.append(vote)
                    toxics.append(y)
                    weights.append(w)
        self.otherwise = float((lone[1] + share) / (lone.sum() + 1))  # without a neighbour
        self.a, self.b = calibrate(np.array(votes), np.array(toxics), np.array(weights))

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def vote(self, places, cosines) -> float | None:
        if not len(places):
            return None
        clean, toxic = cosines**POWER @ (self.texts[places] * self.weight)
        return float((toxic + PRIOR * self.share) / (clean + toxic + PRIOR))

    def score(self, counts: dict[int, int]) -> tuple[float, list[int], list[float]]:
        places, cosines = self.index.nearest(self.vector(counts), K) if counts else ([], [])
        v = self.vote(places, cosines) if len(places) else None
        if v is None:
            return self.otherwise, [], []
        p = 1 / (1 + math.exp(-(self.a * float(log_odds(v)) + self.b)))
        near = [(i, float(c)) for p_, c in zip(places[:3].tolist(), cosines) for i in self.ids[p_]][:3]
        return p, [i for i, _ in near], [c for _, c in near]


def log_odds(vote):
    v = np.clip(vote, 0.001, 0.999)
    return np.log(v / (1 - v))


def calibrate(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' log-odds: damped
    Newton steps from the identity, with a pull to it; the slope stays positive."""
    if not len(votes) or toxic.min() == toxic.max():
        return 1.0, 0.0
    x = np.stack((log_odds(votes), np.ones(len(votes))))
    start = np.array([1.0, 0.0])

    def loss(ab):
        z = ab @ x
        return weight @ (np.logaddexp(0, z) - toxic * z) + ((ab - start) ** 2).sum() / 2

    ab = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        gradient = x @ (weight * (p - toxic)) + (ab - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + np.eye(2), gradient)
        while loss(ab - step) > loss(ab) and abs(step).max() > 1e-9:
            step = step / 2
        if abs(step).max() <= 1e-9:
            break
        ab = ab - step
    return max(float(ab[0]), 0.05), float(ab[1])


def labels_of(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row per labelled id (1 if any of its rows says 1)."""
    return (common.only(labels, doc_id="long", toxic="int")
            .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows where `usable` (a column of doc_id) holds.

    Without any the score is 0 everywhere; with one class only it is that
    class's share, smoothed.  Repeated rows of an id count once each.
    """
    common.small_batches(docs)
    known = common.cut(labels_of(labels).filter(usable), "toxic-labels")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    if not total:
        return Model({}, np.empty(0), [], [], [], 0.0)
    part = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000))
    limit = F.create_map(*[F.lit(x) for c, k in n.items()
                           for x in (c, int(1e6 * min(1.0, per_class / k)) + 1)])
    chosen = known.filter(part < limit[F.col("toxic")])
    def sketched(batches):
        words = Words()
        for batch in batches:
            for piece, texts in common.slices(batch, 1, 1_000_000):
                sets = [shingles(x, words) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array([node_of(g) if len(g) else None for g in sets],
                                              pa.int64())],
                    names=["doc_id", "text", "toxic", "sketch"])

    # bounded by the sample: about two times per_class rows of two numbers;
    # texts of one class with the same whole set of shingles, copies, count once
    sample = (common.only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
              .select("doc_id", "text", "toxic")
              .mapInArrow(sketched, "doc_id long, text string, toxic int, sketch long")
              .groupBy("toxic", "sketch").agg(F.min(F.struct("doc_id", "text")).alias("x"))
              .select("x.doc_id", "x.text", "toxic"))
    sample = common.cut(sample, "toxic-sample")

    def sets(batches):
        for batch in batches:
            for piece, texts in common.slices(batch, 1, 1_000_000):
                found = [sorted({t for w in set(WORD.findall(x.lower())) for t in terms_of(w)})
                         for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(2), pa.array(found, pa.list_(pa.string()))],
                    names=["toxic", "terms"])

    sizes = {r["toxic"]: r["n"] for r in
             sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    rows = max(1, n1 + n0)
    df = (sample.select("doc_id", "text", "toxic").mapInArrow(sets, "toxic int, terms array<string>")
          .select("toxic", F.explode("terms").alias("term")).groupBy("term")
          .agg(F.sum("toxic").alias("x1"), F.sum(1 - F.col("toxic")).alias("x0")))
    p = (F.col("x1") + F.col("x0")) / rows
    z = (F.col("x1") / max(1, n1) - F.col("x0") / max(1, n0)) / F.sqrt(
        p * (1 - p) * (1 / max(1, n1) + 1 / max(1, n0)) + 1e-12)
    best = (df.filter(F.col("x1") + F.col("x0") >= LEAST).withColumn("z", z)
            .filter((F.col("z") >= BEYOND)
                    & (F.col("x1") / max(1, n1) >= LIFT * (F.col("x0") + 0.5) / max(1, n0)))
            .orderBy(F.desc("z"), "term").limit(VOCABULARY).collect())
    number = {r["term"]: i for i, r in enumerate(sorted(best, key=lambda r: r["term"]))}
    idf = np.zeros(len(number))
    for r in best:
        idf[number[r["term"]]] = math.log((rows + 1) / (r["x1"] + r["x0"] + 1)) + 1

    def vectors(batches):
        terms = Terms(number)
        for batch in batches:
            for piece, texts in common.slices(batch, 1, 1_000_000):
                counts = [count(terms, x) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2),
                     pa.array([sorted(c) for c in counts], pa.list_(pa.int32())),
                     pa.array([[c[t] for t in sorted(c)] for c in counts], pa.list_(pa.int32()))],
                    names=["doc_id", "toxic", "terms", "times"])

    got = sample.select("doc_id", "text", "toxic").mapInArrow(
        vectors, "doc_id long, toxic int, terms array<int>, times array<int>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["terms"], r["times"]))
    return Model(number, idf, [r["doc_id"] for r in got],
                 [r["toxic"] for r in got], [dict(zip(r["terms"], r["times"])) for r in got],
                 n.get(1, 0) / total)


def count(terms: Terms, text: str) -> Counter:
    """Vocabulary term -> times in the whole text."""
    return Counter([t for found in map(terms.__getitem__, WORD.findall(text.lower())) if found
                    for t in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), evidence (ids of the
    nearest examples) and similarity (their cosines).

    Null and empty texts, and texts without a known term, get the share of
    toxic texts among such examples.  Repeated rows are scored one by one;
    extra columns are ignored; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        terms, seen = Terms(m.number), {}
        for batch in batches:
            for piece, texts in common.slices(batch, 1, 1_000_000):
                got = []
                for x in texts:
                    counts = count(terms, x)
                    key = frozenset(counts.items())
                    if key not in seen:
                        if len(seen) >= 50_000:
                            seen.clear()
                        seen[key] = m.score(counts)
                    got.append(seen[key])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([g[0] for g in got], pa.float64()),
                     pa.array([g[1] for g in got], pa.list_(pa.int64())),
                     pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                    names=["doc_id", "score", "evidence", "similarity"])

    return common.small_batches(common.only(docs, doc_id="long", text="string")).mapInArrow(
        run, "doc_id long, score double, evidence array<bigint>, similarity array<double>")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score below `least`.

    Null and empty texts score as texts without a known term; repeated rows get
    one score each; an empty table gives an empty result."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = common.position(docs, "text")

    def run(batches):
        m = shipped.value
        terms = Terms(m.number)
        for batch in batches:
            for piece, texts in common.slices(batch, at, 1_000_000):
                yield piece.filter(pa.array(
                    [m.score(c)[0] < least for c in (count(terms, x) for x in texts)], pa.bool_()))

    return common.small_batches(docs).mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, similarity; labels of the
    held-out fold are never learned from."""
    f = common.fold(F.col("doc_id"), folds)
    model = fit(docs, labels, F.coalesce(f != held, F.lit(False)))
    return score(docs, model).select(
        "doc_id", F.coalesce(f == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "similarity")
