"""Embedding near-dedup against DuckDB and brute force."""
import numpy as np

from basketry.llm import embeddings
from helpers import same_as_oracle

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def test_matches_duckdb(spark):
    same_as_oracle(spark, "op2_embedding_near_dedup")


def brute(rows):
    ok = [(i, np.asarray(v, np.float64), g) for i, v, g, _ in rows
          if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    link = {k: set() for k in range(len(ok))}
    for x, (_, a, g) in enumerate(ok):
        for y, (_, b, h) in enumerate(ok[:x]):
            if g == h and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                link[x].add(y)
                link[y].add(x)
    out = {}
    for x in link:
        seen, todo = {x}, [x]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        out[ok[x][0]] = (len(link[x]), min(ok[k][0] for k in seen))
    return out


def test_many_shards_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label, n in ((1, 260), (2, 90), (3, 1)):
        base = rng.standard_normal((n, 16)).astype(np.float32)
        base[n // 2:] = base[:n - n // 2] + rng.standard_normal((n - n // 2, 16)).astype(np.float32) * 0.12
        rows += [(len(rows) + k, [float(x) for x in v], label, "x") for k, v in enumerate(base)]
    common = rows[0][1]
    near = [[float(x) for x in np.float32(common) + rng.standard_normal(16).astype(np.float32) * 0.03]
            for _ in range(60)]
    rows += [(1000 + k, v, 1, "x") for k, v in enumerate(near)]
    rows += [(2000 + k, common, 1, "x") for k in range(30)]
    rows += [(3000, None, 1, "x"), (3001, [0.0] * 16, 1, "x"), (3002, [float("nan")] + [1.0] * 15, 1, "x"),
             (3003, common, None, "x"), (3004, [], 1, "x"), (3005, [None] + [1.0] * 15, 1, "x"),
             (3006, [float("inf")] * 16, 1, "x"), (3007, common[:8], 1, "x"), (None, common, 1, "x")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=70).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        n, comp = want.get(r["vec_id"], (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, comp, r["vec_id"] is not None and comp == r["vec_id"])
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 32))
    v[700:] = v[:800] + 0.05 * rng.standard_normal((800, 32))
    unit = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    graph = embeddings.Graph(unit, np.arange(1500))
    assert len(graph.levels) > 1
    a, b = embeddings.hits(graph, unit, 0.98)
    true = set(zip(*np.nonzero(unit @ unit.T >= 0.98)))
    assert len(true & set(zip(a.tolist(), b.tolist()))) >= 0.99 * len(true)
    lone = embeddings.Graph(unit[:1], np.arange(1))
    assert [x.tolist() for x in embeddings.hits(lone, unit[:1], 0.98)] == [[0], [0]]


def test_forest():
    assert len(embeddings.forest([1, 2, 3, 1], [2, 3, 1, 3])) == 2
