"""Toxicity: the index against brute force, held-out results, edge rows."""
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import queries, toxicity
from helpers import docs


def test_index_matches_brute_force():
    rng = random.Random(2)
    vectors = []
    for _ in range(500):
        v = {rng.randrange(40): rng.random() + 0.1 for _ in range(rng.randrange(1, 9))}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / norm for t, w in v.items()})
    times = np.array([rng.randrange(1, 4) for _ in vectors])
    index = toxicity.Index(vectors, times)
    for q in vectors[:60] + [{99: 1.0}, {0: 1.0}]:
        exact = sorted(((sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vectors)),
                       key=lambda x: (-x[0], x[1]))
        exact = [(c, i) for c, i in exact if c > 0]
        total, least = 0, 0.0
        for c, i in exact:
            total += times[i]
            if total >= 25:
                least = c
                break
        want = [i for c, i in exact if c >= least - 1e-9]
        places, cosines = index.nearest(q, 25)
        assert sorted(places.tolist()) == sorted(want)
        assert np.allclose(sorted(cosines), sorted(c for c, i in exact if i in set(want)))


def test_calibration_stays_sane():
    assert toxicity.calibrate(np.empty(0), np.empty(0), np.empty(0)) == (1.0, 0.0)
    a, b = toxicity.calibrate(np.array([0.0, 0.0, 1.0, 1.0]), np.array([0, 0, 1, 1]), np.ones(4))
    assert a >= 1 and abs(b) < 1
    a, _ = toxicity.calibrate(np.array([0.1, 0.2, 0.8, 0.9]), np.array([1, 1, 0, 0]), np.ones(4))
    assert a > 0


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    got = queries.QUERIES["op4_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    toxic = [p for p, y in held if y == 1]
    clean = [p for p, y in held if y == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(20)] + (["Awful!"] if i % 4 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(400)] +
                                   [(None, 1, None), (7, None, None), (3, 5, None), (4, 1, None), (99_999, 1, None)],
                                   "doc_id long, toxic int, text string")
    rows += [(1000, None), (1001, ""), (None, "so AWFUL"), (1002, "awful " * 30_000), (1002, "awful")]
    d = docs(spark, rows).withColumn("score", F.lit("mine"))
    got = toxicity.judge(d, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["predicted"] == 1 and not by[None]["held_out"] and by[1002]["predicted"] == 1
    assert by[1000]["predicted"] == by[1001]["predicted"] == 0 and by[1000]["evidence"] == []
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] in range(400))
    assert all(i % 5 for i in (zlib.crc32(str(x).encode()) for r in got for x in r["evidence"]))
    model = toxicity.fit(d, labels, F.lit(True))
    kept = toxicity.keep(d, model)
    assert kept.columns == d.columns and kept.count() == 300 + 2
    assert toxicity.judge(d.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.judge(d, labels.limit(0)).collect()} == {0.0}


def test_only_copies_count_once(spark):
    """Texts that share a long passage are examples of their own; exact copies are one."""
    passage = " ".join(f"word{i}" for i in range(300))
    rows = [(i, f"{passage} end{i % 30} of {i % 30}") for i in range(60)] + [(60, "AWFUL thing"), (61, ""), (62, None)]
    labels = spark.createDataFrame([(i, int(i == 60)) for i in range(63)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels, F.lit(True))
    assert model.texts.sum(axis=0).tolist() == [30 + 1, 1]
