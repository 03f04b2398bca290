"""Embedding near-duplicates by navigable small-world graphs per shard.

Equal vectors of one label are one class.  The classes of a label are dealt by
a hash into shards of about SHARD; each shard gets a hierarchical navigable
small-world graph (levels by a hash, diverse nearest neighbours and their
reverse edges on every level).  Every shard is queried with the classes of
every shard of its label: a greedy descent, then a beam on the lowest level.
A beam full of hits is widened; so is every beam of a task whose audit (a
spread of its queries against brute force) finds a hit missed, until the audit
passes.  Hits are verified by cosine in double precision.

A task holds two shards.  It returns sums of links per class and a spanning
forest of its links, not the links, so a large group of near copies costs rows
in proportion to its size.  Components are united from the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.components import components
from basketry.llm import common

SHARD = 2_000
#: Neighbours chosen on a level, edges kept with the reverse ones, the mean of
#: the levels' shrinkage, the first beam, and queries per audit.
M, EDGES, SHRINK, BEAM, AUDIT = 12, 32, 12, 16, 64
#: A beam that holds a WHOLE-th of the shard is as good as all of it; beams
#: widen by WIDEN.
WHOLE, WIDEN = 8, 4


class Graph:
    """Of unit vectors (float32): per level its nodes and padded neighbour lists."""

    def __init__(self, unit: np.ndarray, seeds: np.ndarray):
        self.unit, n = unit, len(unit)
        u = (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / 2.0**53
        level = np.floor(-np.log(u + 1e-18) / np.log(SHRINK)).astype(int)
        level[np.argmax(level)] = max(1, level.max()) if n > 1 else 0
        self.levels = []
        for k in range(level.max() + 1):
            nodes = np.flatnonzero(level >= k)
            if k and len(nodes) == len(self.levels[-1][0]):
                break
            self.levels.append((nodes, self.link(nodes)))

    def link(self, nodes: np.ndarray) -> np.ndarray:
        """(all nodes, EDGES) neighbours on one level, -1 for none."""
        out = np.full((len(self.unit), EDGES), -1, np.int32)
        n = len(nodes)
        if n < 2:
            return out
        x = self.unit[nodes]
        c = min(2 * M, n - 1)
        a, b, w = [], [], []
        for i in range(0, n, 512):
            sim = x[i:i + 512] @ x.T
            rows = np.arange(len(sim))
            sim[rows, rows + i] = -2
            near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
            near = np.take_along_axis(near, np.argsort(
                -np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
            own = np.take_along_axis(sim, near, 1)
            between = np.einsum("rid,rjd->rij", x[near], x[near])
            chosen = np.zeros((len(sim), c), bool)
            for j in range(c):  # keep what is nearer to the node than to the kept ones
                worst = np.where(chosen, between[:, :, j], -2).max(axis=1)
                chosen[:, j] = (own[:, j] >= worst) & (chosen.sum(axis=1) < M)
            chosen[:, :2] = True  # the two nearest in any case
            r, j = np.nonzero(chosen)
            a.append(r + i)
            b.append(near[r, j])
            w.append(own[r, j])
        a, b, w = np.concatenate(a), np.concatenate(b), np.concatenate(w)
        a, b, w = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w))
        _, first = np.unique(a * np.int64(n) + b, return_index=True)
        a, b, w = a[first], b[first], w[first]
        order = np.lexsort((-w, a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        kept = rank < EDGES
        out[nodes[a[kept]], rank[kept]] = nodes[b[kept]]
        return out

    def descend(self, q: np.ndarray) -> np.ndarray:
        """Per query the node where the lowest level's search starts."""
        nodes, _ = self.levels[-1]
        at = nodes[np.argmax(q @ self.unit[nodes].T, axis=1)]
        for _, edges in reversed(self.levels[1:]):
            best = np.einsum("qd,qd->q", q, self.unit[at])
            live = np.arange(len(q))
            while len(live):
                near = edges[at[live]]
                sim = np.einsum("qd,qed->qe", q[live], self.unit[near])
                sim[near < 0] = -2
                j = sim.argmax(axis=1)
                top = sim[np.arange(len(live)), j]
                up = top > best[live]
                live, j, top = live[up], j[up], top[up]
                at[live], best[live] = near[up, j], top
        return at

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, beam) nodes and their cosines, best first; -1 and -2 where
        fewer were met.  A beam of a WHOLE-th of the shard or more gives every
        node, unsorted."""
        n, m = len(self.unit), len(q)
        if beam * WHOLE >= n:  # wide enough to visit (almost) every node: visit all at once
            sims = q @ self.unit.T
            return np.broadcast_to(np.arange(n, dtype=np.int32), (m, n)), sims
        ids, sims = np.full((m, beam), -1, np.int32), np.full((m, beam), -2, np.float32)
        ids[:, 0] = self.descend(q)
        sims[:, 0] = np.einsum("qd,qd->q", q, self.unit[ids[:, 0]])
        seen = np.zeros((m, n + 1), bool)  # the last column takes the padding
        seen[np.arange(m), ids[:, 0]] = True
        done = np.zeros((m, beam), bool)
        live, edges = np.arange(m), self.levels[0][1]
        while len(live):
            open_ = (ids[live] >= 0) & ~done[live]
            some = open_.any(axis=1)
            live, j = live[some], open_[some].argmax(axis=1)
            if not len(live):
                break
            done[live, j] = True
            near = edges[ids[live, j]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            sim = np.einsum("qd,qed->qe", q[live], self.unit[near])
            sim[~fresh] = -2
            all_sims = np.concatenate((sims[live], sim), axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_sims, order, 1)
            ids[live] = np.where(sims[live] > -2, np.take_along_axis(
                np.concatenate((ids[live], near), axis=1), order, 1), -1)
            done[live] = np.take_along_axis(np.concatenate(
                (done[live], np.zeros_like(fresh)), axis=1), order, 1)
        return ids, sims


def hits(graph: Graph, q: np.ndarray, least: float, block: int = 512):
    """(query, node) of all cosines of `least` or more that the search finds,
    with beams widened until the audit of the queries passes."""
    n, beam = len(graph.unit), BEAM
    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    true = q[audit] @ graph.unit.T >= least
    while True:
        found = []
        todo, width = np.arange(len(q)), beam
        while len(todo):
            full = []
            for i in range(0, len(todo), block):
                part = todo[i:i + block]
                ids, sims = graph.search(q[part], width)
                good = sims >= least
                more = good[:, -1] & (width * WHOLE < n)
                full.append(part[more])
                r, j = np.nonzero(good & ~more[:, None])
                found.append((part[r], ids[r, j]))
            todo, width = np.concatenate(full), width * WIDEN
        a, b = (np.concatenate(x) for x in zip(*found))
        got = np.zeros_like(true)
        inside = np.isin(a, audit)
        got[np.searchsorted(audit, a[inside]), b[inside]] = True
        if beam * WHOLE >= n or not (true & ~got).any():
            return a, b
        beam *= WIDEN


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    out = []
    for x, y in zip(a, b):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


SHARDS = ("group long, shard int, shards int, ids binary, sizes binary, vectors binary")
RESULT = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def pack(table: pa.Table) -> pa.Table:
    """The classes of one shard as one row."""
    table = table.sort_by("rep")
    as_ = lambda c, t: np.asarray(table.column(c).to_numpy(), t).tobytes()
    vectors = table.column("vector").combine_chunks()
    return pa.table({
        "group": table.column("group")[:1], "shard": table.column("shard")[:1],
        "shards": table.column("shards")[:1], "ids": [as_("rep", np.int64)],
        "sizes": [as_("size", np.int64)],
        "vectors": [np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), "<f8").tobytes()]})


def compare(least: float):
    """One or two shard rows -> sums of links per class, and forest edges."""
    def run(table: pa.Table) -> pa.Table:
        shards = []
        for row in sorted(table.to_pylist(), key=lambda r: r["shard"]):
            ids = np.frombuffer(row["ids"], np.int64)
            v = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
            shards.append((ids, np.frombuffer(row["sizes"], np.int64), v,
                           v / np.sqrt((v * v).sum(axis=1))[:, None]))
        (ids_a, size_a, _, unit_a), (ids_b, size_b, _, unit_b) = shards[0], shards[-1]
        graph = Graph(unit_b.astype(np.float32), ids_b)
        a, b = hits(graph, unit_a.astype(np.float32), least - 1e-5)
        if len(shards) == 1:
            a, b = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack((a[a < b], b[a < b]), axis=1), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
        va, vb = shards[0][2][a], shards[-1][2][b]
        cosine = np.einsum("pd,pd->p", va, vb) / np.sqrt(
            np.einsum("pd,pd->p", va, va) * np.einsum("pd,pd->p", vb, vb))
        a, b = a[cosine >= least], b[cosine >= least]
        links_a = np.bincount(a, size_b[b], len(ids_a)).astype(np.int64)
        links_b = np.bincount(b, size_a[a], len(ids_b)).astype(np.int64)
        edges = forest(ids_a[a].tolist(), ids_b[b].tolist())
        rep = [*ids_a[links_a > 0], *ids_b[links_b > 0], *(x for x, _ in edges)]
        links = [*links_a[links_a > 0], *links_b[links_b > 0], *[0] * len(edges)]
        other = [None] * (len(rep) - len(edges)) + [y for _, y in edges]
        return pa.table({"rep": pa.array(rep, pa.int64()), "links": pa.array(links, pa.int64()),
                         "other": pa.array(other, pa.int64())}, schema=RESULT)

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.98, shard: int = SHARD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and their
    lengths are equal.  Vectors that are null, empty, zero or hold a null or
    non-finite component, rows without a label and rows without an id link with
    nothing (without an id the component is null too).  Repeated rows are
    copies of each other, each counted.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    e = common.only(embeddings, vec_id="long", label="string", embedding="array<double>")
    e = e.withColumn("usable", F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND "
        "NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND "
        "exists(embedding, x -> x <> 0)"))
    e = e.select("vec_id", F.when(F.col("usable"), F.xxhash64("label", F.size("embedding"))).alias("group"),
                 F.when(F.col("usable"), F.xxhash64("embedding", "label")).alias("h1"),
                 F.when(F.col("usable"), F.xxhash64(F.lit(7), "embedding", "label")).alias("h2"),
                 "embedding")
    classes = e.filter("group IS NOT NULL").groupBy("group", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"),
        F.min("embedding").alias("vector"))
    classes = common.cut(classes, "vector-classes")
    counts = classes.groupBy(F.col("group").alias("g")).agg(
        F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = classes.join(counts, F.col("group") == F.col("g")).select(
        "group", "rep", "size", "vector", "shards",
        F.pmod(F.xxhash64("h1"), F.col("shards")).cast("int").alias("shard"))
    shards = common.cut(dealt.groupBy("group", "shard").applyInArrow(pack, SHARDS), "vector-shards")
    # every pair of shards of a group, once: each shard goes to all its pairs
    met = shards.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("with"))
    met = met.withColumns({"lo": F.least("shard", "with"), "hi": F.greatest("shard", "with")})
    got = common.cut(met.select("group", "lo", "hi", "shard", "ids", "sizes", "vectors")
                     .groupBy("group", "lo", "hi")
                     .applyInArrow(compare(least), "rep long, links long, other long"), "vector-links")
    links = got.groupBy(F.col("rep").alias("of")).agg(F.sum("links").alias("links"))
    comp = components(got.filter("other IS NOT NULL").select(F.col("rep").alias("a"),
                                                             F.col("other").alias("b")))
    classes = (classes.select("rep", "size", F.col("h1").alias("c1"), F.col("h2").alias("c2"))
               .join(links, F.col("rep") == F.col("of"), "left")
               .join(comp, F.col("rep") == F.col("node"), "left")
               .select("c1", "c2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
                       F.coalesce("component", "rep").alias("component")))
    out = e.select("vec_id", "h1", "h2").join(
        classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
