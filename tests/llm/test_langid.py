"""Language ID: gradients against differences, held-out accuracy, edge rows."""
import zlib

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import langid, queries
from helpers import docs


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Net(3, rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = rng.integers(97, 123, (langid.WIDTH, 4)).astype(np.uint8)
    y = np.array([0, 1, 2, 1])

    def loss():
        p = net.probabilities(x)[:, y, np.arange(4)]
        m = langid.LETTER[x]
        return float(-(np.log(p) * m).sum() / m.sum())

    got = net.gradients(x, y)
    for name, w in net.w.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name[0] == "x":
                at = (at[0], int(x[rng.integers(0, langid.WIDTH), 0]))
            old, eps = w[at], 2e-2
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            slope = (up - loss()) / (2 * eps)
            w[at] = old
            assert abs(slope - got[name][at]) < 2e-4 + 0.05 * abs(slope), name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d = queries.table(spark, sf, "documents")
    lang = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    got = queries.QUERIES["op8_language_id"](spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(spark):
    rows = [(i, f"the house of the tree {i} and the river", "en") for i in range(40)]
    rows += [(100 + i, f"la maison de l'arbre {i} et la rivière", "fr") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "123 !?", "en"), (None, "the house and the tree", None),
             (203, "the river " * 20_000, None), (203, "the river " * 20_000, None), (204, "é", None)]
    d = docs(spark, rows).withColumn("lang_pred", F.lit("mine"))
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert langid.identify(d).count() == len(rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202))
    assert got[203]["lang_pred"] == "en" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    assert got[204]["lang_pred"] in ("en", "fr")
    model = langid.fit(d, langid.usable_fold(F.col("doc_id")))
    kept = langid.keep(d, model)
    assert kept.columns == d.columns and {200, 201, 202}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_no_or_one_language(spark):
    none = docs(spark, [(1, "some text"), (2, None)])
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}
    one = docs(spark, [(i, "some text", "en") for i in range(9)])
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"en"}
    assert langid.identify(none.limit(0)).count() == 0
