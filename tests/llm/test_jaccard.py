"""N-gram Jaccard join against DuckDB and brute force."""
import random

import numpy as np
from pyspark.sql import functions as F

from basketry.functions.components import components
from basketry.llm import jaccard
from helpers import docs, same_as_oracle


def test_matches_duckdb(spark):
    same_as_oracle(spark, "op1_ngram_jaccard_join")


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """doc_id -> (set size, component)."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        low[root(x)] = min(i, low.get(root(x), i))
    return {i: (len(s), low[root(x)]) for x, (i, s) in enumerate(sets)}


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"n{rng.random()}"
    return " ".join(w)


def corpus(seed):
    """Copies, near copies at all distances (a group far larger than RUN, too),
    chains, a passage that many texts share, short texts and null rows."""
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    out, passage = [], text(55)
    for n in (1, 3, 4, 5, 6, 9, 12, 20, 40, 64, 70, 130, 260, 300, 800):
        base = text(n)
        out += [base, base.upper().replace(" ", "\n"), edited(rng, base, 0.01), edited(rng, base, 0.03),
                edited(rng, base, 0.06), base + " " + text(max(1, n // 4))]
    base = text(150)
    out += [edited(rng, base, 0.02) for _ in range(45)]
    for _ in range(30):  # a chain
        base = edited(rng, base, 0.02)
        out.append(base)
    out += [f"{text(rng.randrange(5, 60))} {passage} {text(rng.randrange(5, 200))}" for _ in range(60)]
    return [(i, t) for i, t in enumerate(out)]


def test_matches_brute_force(spark):
    rows = corpus(1) + [(900, None), (901, ""), (902, " \t\n"), (None, "a b c d e f"), (903, "a b c d e f"),
                        (903, "A b C d e f"), (903, "quite another text of seven words"), (904, "a\u00a0b c")]
    d = docs(spark, rows).withColumn("component_id", F.lit("mine"))
    got = jaccard.near_duplicates(d).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] != 903])
    for r in got:
        if r["doc_id"] in want:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, 2, None)]
    assert jaccard.near_duplicates(d.limit(0)).count() == 0


def test_one_document_of_a_group_stays(spark):
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, None), (6, None), (None, "a b c d e f"),
            (7, "x y")]
    d = docs(spark, rows).withColumn("node", F.lit(1))
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 5, 6, 7]


def test_promised_fingerprints():
    """Any similar pair shares the promised number, in sketches and in single parts."""
    rng = random.Random(3)
    words = jaccard.Words()
    for n in list(range(1, 80)) + [100, 200, 255, 256, 300, 500, 1000, 1100]:
        base = " ".join(f"w{rng.randrange(10**7)}" for _ in range(n + 4))
        w = base.split()
        w[len(w) // 2] = "edited"
        a, b = jaccard.shingles(base, words), jaccard.shingles(" ".join(w), words)
        both = len(np.intersect1d(a, b))
        if 4 * both < 3 * (len(a) + len(b) - both) or len(a) + len(b) == 2 * both:
            continue
        big = max(jaccard.band(len(a)), jaccard.band(len(b)))
        for single in (False, True):
            keys, spare = [], []
            for x in (a, b):
                for scheme, d in jaccard.schemes(len(x)):
                    if scheme == big:
                        k, s = jaccard.fingerprints(x, scheme, d, single)
                        keys.append(k)
                        spare.append(s)
            assert min(spare) >= 1 and len(np.intersect1d(*keys)) >= min(spare)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5), (7, 6), (7, 6)]
    edges += [(200, 200 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in
           components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100,
                   **{i: 200 for i in range(200, 250)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for scheme in range(6):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, 4**scheme + 2).astype(np.uint64))
            b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.8],
                                          rng.integers(0, 2**63, 3).astype(np.uint64))))
            x, y = jaccard.sketch(a, scheme), jaccard.sketch(b, scheme)
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        assert not (jaccard.sketch(a, scheme) ^ jaccard.sketch(a, scheme)).any()


def test_large_fingerprints_are_dealt_in_blocks(spark, monkeypatch):
    """Many near copies, with blocks of a few nodes: the same groups."""
    monkeypatch.setattr(jaccard, "BLOCK", 2_000)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:55] + [f"x{i}{j}" for j in range(i % 4)])) for i in range(120)]
    rows += [(500 + i, " ".join(base[:30] + [f"y{i}_{j}" for j in range(30)])) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_blocks_find_the_pairs_of_whole_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2 ** 63, (6, 4)).astype(np.uint64)
    rows = []
    for key in (1, 2, 3):
        for node in rng.choice(10_000, 70, replace=False).tolist():
            sketch = bits[node % 6] ^ np.uint64(1 << (node % 50))
            rows.append((key, node, 100 + node % 40, node % 9, sketch.tobytes()))
    schema = "key long, node long, n long, component long, sketch binary"

    def pairs(hubs):
        df = jaccard.dealt(spark.createDataFrame(rows, schema), hubs)
        found = df.mapInArrow(jaccard.near_pairs(hubs), "a long, b long, shared long").groupBy("a", "b").agg(
            F.sum("shared")).collect()
        return sorted(map(tuple, found))

    for hubs in (1, 4, None):
        monkeypatch.setattr(jaccard, "BLOCK", 10 ** 9)
        whole = pairs(hubs)
        monkeypatch.setattr(jaccard, "BLOCK", 300)
        assert whole and pairs(hubs) == whole
