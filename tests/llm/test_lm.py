"""LM scoring against a brute-force model with dictionaries."""
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import lm, queries
from helpers import SF, docs


def brute(rows, target):
    """The same interpolated models, with exact counts of the hashed slots."""
    def grams(text):
        x = b"\0\0\0" + (text or "").encode()
        out = []
        for i in range(3, len(x)):
            two, three, four = (int.from_bytes(x[i - k:i + 1], "big") for k in (1, 2, 3))
            mix = lambda v: (((v ^ (v >> 15)) * 2654435761) & 0xFFFFFFFF) >> (32 - lm.BITS)
            out.append((x[i], two, mix(three), mix(four)))
        return out

    counts = [[Counter() for _ in range(4)] for _ in (0, 1)]
    for i, text in rows:
        for g in grams(text):
            for k in range(4):
                counts[i not in target][k][g[k]] += 1
    tokens = [sum(c[0].values()) for c in counts]
    scale = [1.0, tokens[0] / tokens[1] if min(tokens) else 1.0]
    out = {}
    for i, text in rows:
        loss, before = [0.0, 0.0], (0, 0, 0, 0)
        for g in grams(text):
            for m in (0, 1):
                n = [{k: v * scale[m] for k, v in c.items()} for c in ()] or None
                c = lambda k, v: counts[m][k][v] * scale[m]
                one = (c(0, g[0]) + lm.ALPHA / 256) / (tokens[m] * scale[m] + lm.ALPHA)
                row = sum(v for k, v in counts[m][1].items() if k >> 8 == g[1] >> 8) * scale[m]
                two = (c(1, g[1]) + lm.ALPHA * one) / (row + lm.ALPHA)
                three = (min(c(2, g[2]), c(1, before[1])) + lm.ALPHA * two) / (c(1, before[1]) + lm.ALPHA)
                four = (min(c(3, g[3]), c(2, before[2])) + lm.ALPHA * three) / (c(2, before[2]) + lm.ALPHA)
                loss[m] -= math.log(four)
                assert n is None
            before = g
        n = len((text or "").encode())
        out[i] = (n, (loss[0] - loss[1]) / n if n else 0.0)
    return out


def test_matches_brute_force(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the cat ate"), (3, "## || ## %%"), (4, None), (5, ""),
            (6, "ünïcode the"), (7, "a")]
    d = docs(spark, rows).withColumn("score", F.lit("mine"))
    target = spark.createDataFrame([(1,), (2,), (None,), (2,), (77,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm.difference(d, target).collect()}
    for i, (n, score) in brute(rows, {1, 2}).items():
        assert got[i]["n_tokens"] == n and abs(got[i]["score"] - score) < 1e-4
    assert got[4]["loss_target"] is None and got[3]["score"] > got[2]["score"]
    assert lm.difference(d.limit(0), target).count() == 0
    assert lm.difference(d, target.limit(0)).count() == 7


def test_chunks_do_not_change_losses(monkeypatch):
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abc déf"), 500))
    counts = rng.integers(0, 50, (lm.SIZE, 2))
    model = lm.Model(counts)
    whole = sum(model.losses(*c) for c in lm.chunks(text))
    monkeypatch.setattr(lm, "CHUNK", 64)
    assert len(list(lm.chunks(text))) > 5
    assert np.allclose(whole, sum(model.losses(*c) for c in lm.chunks(text)), rtol=1e-5)


def test_poor_documents_score_higher(spark):
    quality = {r["doc_id"]: r["quality"] for r in queries.table(spark, SF, "labels").collect()}
    got = [(r["score"], quality[r["doc_id"]]) for r in queries.QUERIES["op9_lm_scoring"](spark, SF).collect()
           if r["doc_id"] in quality]
    mean = lambda q: np.mean([s for s, y in got if y == q])
    assert mean(0) > mean(1)


def exact(rows, target):
    """Brute force over counts in dictionaries whose keys are the n-grams themselves."""
    led = {i: b"\0\0\0" + (text or "").encode() for i, text in rows}
    n = {(m, k): Counter(x[i - k + 1:i + 1] for d, x in led.items() if (d not in target) == m
                         for i in range(3, len(x))) for m in (0, 1) for k in (1, 2, 3, 4)}
    tokens = [sum(n[m, 1].values()) for m in (0, 1)]
    follow = {m: Counter() for m in (0, 1)}
    for m in (0, 1):
        for g, v in n[m, 2].items():
            follow[m][g[:1]] += v
    out = {}
    for d, x in led.items():
        loss = [0.0, 0.0]
        for i in range(3, len(x)):
            for m in (0, 1):
                s = tokens[0] / tokens[1] if m and min(tokens) else 1.0
                c = lambda k, end: n[m, k][x[end - k:end]] * s  # noqa: B023, E731
                p = (c(1, i + 1) + lm.ALPHA / 256) / (tokens[m] * s + lm.ALPHA)
                p = (c(2, i + 1) + lm.ALPHA * p) / (follow[m][x[i - 1:i]] * s + lm.ALPHA)
                p = (min(c(3, i + 1), c(2, i)) + lm.ALPHA * p) / (c(2, i) + lm.ALPHA)
                p = (min(c(4, i + 1), c(3, i)) + lm.ALPHA * p) / (c(3, i) + lm.ALPHA)
                loss[m] -= math.log(p)
        out[d] = (loss[0] - loss[1]) / (len(x) - 3) if len(x) > 3 else 0.0
    return out


def test_counts_are_of_unhashed_ngrams(spark, monkeypatch):
    """Random text of far more distinct 4-grams than 2**16, scored while its table
    travels, and by joins with small flushes; repeated, null and empty rows too."""
    rng = np.random.default_rng(1)
    rows = [(i, "".join(map(chr, rng.integers(32, 1000, 2500)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a"), (63, "\0\0"), (64, rows[0][1])]
    target = set(range(0, 65, 2))
    want = exact(rows, target)
    d, t = docs(spark, rows), spark.createDataFrame([(i,) for i in target], "doc_id long")
    table = lm.fit(d.select((F.col("doc_id") % 2 == 0).alias("is_target"), "text"))
    assert len(table.four.keys) == len({x[i - 3:i + 1] for _, s in rows for x in [b"\0\0\0" + (s or "").encode()]
                                        for i in range(3, len(x))}) > 150_000
    for limit in (lm.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(lm, "BROADCAST_GRAMS", limit)
        got = lm.difference(d.union(d.limit(1)), t).collect() if limit else lm.difference(d, t).collect()
        assert len(got) == len(rows) + bool(limit)
        if not limit:
            assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-9 for r in got)
            assert {r["doc_id"]: r["n_tokens"] for r in got}[60] == 0
        else:
            one = {r["doc_id"]: r["score"] for r in lm.difference(d, t).collect()}
            assert all(abs(one[i] - w) < 1e-9 for i, w in want.items())


def test_joined_scores_other_documents_alike(spark, monkeypatch):
    rows = [(1, "the cat sat on the mat"), (2, "a dog ran"), (3, None)]
    new = docs(spark, [(7, "the dog sat"), (7, "the dog sat"), (None, "zzz qqq"), (9, ""), (None, None)])
    known = docs(spark, rows).select((F.col("doc_id") == 1).alias("is_target"), "text")
    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    near = sorted(lm.score(new, lm.fit(known)).collect(), key=key)
    monkeypatch.setattr(lm, "BROADCAST_GRAMS", 0)
    far = sorted(lm.score(new, lm.fit(known)).collect(), key=key)
    assert len(far) == 5
    for a, b in zip(near, far):
        assert key(a) == key(b) and (a["loss_target"] is None) == (b["loss_target"] is None)
        assert abs(a["score"] - b["score"]) < 1e-9
