"""Language ID by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of WIDTH.  In each window one GRU
reads forwards and one backwards, and a softmax over both states labels every
position; a document's probabilities are the mean over its letter positions
(letters of ASCII and all bytes from 128 on) in the whole text.  The network
is trained in numpy by backpropagation through time.

Training draws at most about SAMPLE windows, spread evenly over the languages
and, by a hash, over documents and places in their texts: the one bound here,
a documented parameter.  Scoring is row-wise over every byte, without a
shuffle; the weights (some 50 KB) travel with the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common

WIDTH, HIDDEN = 64, 8
SAMPLE = 6_000
STEPS, BATCH, RATE = 240, 256, 0.03
#: Windows that go through the network together.
BLOCK = 1024
UND = "und"

LETTER = np.zeros(256, np.float32)
LETTER[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = 1.0


class Net:
    """Weights by name; arrays are feature-major: (features, windows)."""

    def __init__(self, classes: int, rng: np.random.Generator):
        h = HIDDEN
        normal = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.w = {f"{n}{d}": a for d in "fb" for n, a in (
            ("x", normal(3 * h, 256)), ("u", normal(3 * h, h)), ("c", np.zeros((h, 1), np.float32)))}
        self.w["o"] = normal(classes, 2 * h)
        self.w["ob"] = np.zeros((classes, 1), np.float32)

    def run(self, bytes_: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (WIDTH, HIDDEN, windows) of one direction; gates z and r are
        halves of tanh, so that one call serves both."""
        x, u, c, h = self.w["x" + d], self.w["u" + d], self.w["c" + d], HIDDEN
        width, n = bytes_.shape
        states = np.empty((width, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        gx, gu = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            np.take(x, bytes_[t], axis=1, out=gx, mode="clip")
            np.matmul(u, state, out=gu)
            zr = gx[:2 * h] + gu[:2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1.0
            zr *= 0.5
            m = gu[2 * h:] + c
            new = zr[h:] * m
            new += gx[2 * h:]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, state, zr, m, new))
            # (1 - z) * new + z * state, into the row of this step
            out = states[t]
            np.subtract(state, new, out=out)
            out *= zr[:h]
            out += new
            state = out
        return states

    def probabilities(self, bytes_: np.ndarray, forward=None, backward=None) -> np.ndarray:
        """(WIDTH, classes, windows): the softmax at every position."""
        f = self.run(bytes_, "f") if forward is None else forward
        b = self.run(bytes_, "b") if backward is None else backward
        o, h = self.w["o"], HIDDEN
        p = np.matmul(o[:, :h], f)
        p += np.matmul(o[:, h:], b)
        p += self.w["ob"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, bytes_: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over letter positions, by BPTT."""
        h, g = HIDDEN, {k: np.zeros_like(v) for k, v in self.w.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.run(bytes_, d, kept[d]) for d in "fb"}
        d_logit = self.probabilities(bytes_, states["f"], states["b"])
        d_logit[:, label, np.arange(len(label))] -= 1.0
        mask = LETTER[bytes_][:, None, :]
        d_logit *= mask / max(1.0, float(mask.sum()))
        g["ob"] = d_logit.sum(axis=(0, 2))[:, None]
        for d, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            g["o"][:, at] = np.einsum("tcn,thn->ch", d_logit, states[d])
            d_out = np.matmul(self.w["o"][:, at].T, d_logit)
            u, carry = self.w["u" + d], np.zeros_like(d_out[0])
            for t, before, zr, m, new in reversed(kept[d]):
                z, r = zr[:h], zr[h:]
                d_state = d_out[t] + carry
                d_new = d_state * (1 - z) * (1 - new * new)
                d_r = d_new * m * r * (1 - r)
                d_z = d_state * (before - new) * z * (1 - z)
                d_x = np.concatenate((d_z, d_r, d_new))
                d_u = np.concatenate((d_z, d_r, d_new * r))
                g["u" + d] += d_u @ before.T
                g["c" + d] += (d_new * r).sum(axis=1, keepdims=True)
                for k in range(3 * h):
                    g["x" + d][k] += np.bincount(bytes_[t], d_x[k], 256)
                carry = d_state * z + u.T @ d_u
        return g


def train(windows: np.ndarray, labels: np.ndarray, classes: int, seed: int = 5) -> Net:
    """Adam over random batches; a random tail of some windows is blanked, as
    the last window of a text is padded with zeros."""
    rng = np.random.default_rng(seed)
    net = Net(classes, rng)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    by_class = [np.flatnonzero(labels == c) for c in range(classes)]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(rows, -(-BATCH // classes)) for rows in by_class])
        x = windows[pick].copy()
        ends = np.where(rng.random(len(pick)) < 0.3, rng.integers(4, WIDTH + 1, len(pick)), WIDTH)
        x[np.arange(WIDTH)[None, :] >= ends[:, None]] = 0
        grads = net.gradients(np.ascontiguousarray(x.T), labels[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
        rate = RATE * min(1.0, 3 * (1 - step / (STEPS + 1)))
        for k, v in grads.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Net, classes: int, texts: list[bytes]) -> np.ndarray:
    """(texts, classes): mean probabilities over the letter positions."""
    counts = [-(-len(t) // WIDTH) for t in texts]
    flat = np.zeros((sum(counts), WIDTH), np.uint8)
    at = 0
    for t, n in zip(texts, counts):
        flat[at:at + n].reshape(-1)[:len(t)] = np.frombuffer(t, np.uint8)
        at += n
    sums = np.zeros((len(flat), classes))
    for i in range(0, len(flat), BLOCK):
        x = np.ascontiguousarray(flat[i:i + BLOCK].T)
        sums[i:i + BLOCK] = np.einsum("tcn,tn->nc", net.probabilities(x), LETTER[x])
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.stack([np.bincount(owner, sums[:, c], len(texts)) for c in range(classes)], axis=1)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-9)


class Model:
    """A trained network with its language names; predicts (name, score)."""

    def __init__(self, langs: list[str], net: Net | None):
        self.langs, self.net = langs, net

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out = [(UND, 0.0)] * len(texts)
        live = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        if not self.langs or not live:
            return out
        if self.net is None:
            scored = np.ones((len(live), 1))
        else:
            scored = pooled(self.net, len(self.langs), [texts[i].encode() for i in live])
        best = scored.argmax(axis=1)
        for i, b, row in zip(live, best.tolist(), scored):
            out[i] = (self.langs[b], float(row[b]))
        return out


def learnable(docs: DataFrame, usable: Column) -> DataFrame:
    return common.only(docs, doc_id="long", text="string", lang="string").filter(
        usable & F.col("lang").isNotNull() & F.rlike(F.coalesce("text", F.lit("")), F.lit("\\p{L}")))


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Train on the rows where `usable` holds (a column of doc_id); languages
    are the distinct non-null values of lang there.  One language alone needs
    no network; with none every prediction is `und`."""
    d = learnable(docs, usable)
    counts = {r["lang"]: r["n"] for r in
              d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if len(langs) < 2:
        return Model(langs, None)
    per, each = sample // len(langs) + 1, 6  # windows of a language, and of a document
    share = F.create_map(*[F.lit(x) for k in langs
                           for x in (k, int(1e6 * min(1.0, 2 * per / each / counts[k])) + 1)])
    picked = d.filter(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000))
                      < share[F.col("lang")])
    size = F.length("text")
    starts = F.transform(F.sequence(F.lit(1), F.lit(each)), lambda k: F.pmod(
        F.xxhash64(F.col("doc_id"), k), F.greatest(F.lit(1), size - WIDTH)).cast("int") + 1)
    rows = picked.select("lang", "doc_id", F.transform(
        starts, lambda s: F.substring(F.col("text"), s, F.lit(WIDTH))).alias("parts")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["parts"]))
    x, y, have = [], [], dict.fromkeys(langs, 0)
    for r in rows:
        for p in r["parts"]:
            b = p.encode()[:WIDTH]
            if have[r["lang"]] < per and len(b) >= 4:
                have[r["lang"]] += 1
                x.append(np.frombuffer(b.ljust(WIDTH, b"\0"), np.uint8))
                y.append(langs.index(r["lang"]))
    seen = sorted(set(y))
    if len(seen) < 2:
        return Model([langs[c] for c in seen] or langs[:1], None)
    y = np.searchsorted(seen, np.array(y))
    return Model([langs[c] for c in seen], train(np.stack(x), y, len(seen)))


def predict(docs: DataFrame, model: Model, size: int = 2_000_000) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0; repeated
    rows are judged one by one; extra columns are ignored; an empty table
    gives an empty result.  About `size` characters go through at a time.
    """
    def run(batches):
        for batch in batches:
            for part, texts in common.slices(batch, 1, size):
                got = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    return common.small_batches(common.only(docs, doc_id="long", text="string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.4, size: int = 2_000_000) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose language the model
    names with a score of `least` or more.  A model without languages tells
    none from another: then only null texts and texts without a letter go.
    Languages that tie go by name; repeated rows are judged one by one."""
    at = common.position(docs, "text")

    def run(batches):
        for batch in batches:
            for part, texts in common.slices(batch, at, size):
                if model.langs:
                    fine = [lang != UND and score >= least for lang, score in model.predict(texts)]
                else:
                    fine = [any(map(str.isalpha, t)) for t in texts]
                yield part.filter(pa.array(fine, pa.bool_()))

    return common.small_batches(docs).mapInArrow(run, docs.schema)


def usable_fold(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    """Whether a row may be learned from."""
    return F.coalesce(common.fold(doc_id, folds) != held, F.lit(False))


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned only from documents outside
    the held-out fold; a row with a null id is neither learned nor held out."""
    f = common.fold(F.col("doc_id"), folds)
    out = predict(docs, fit(docs, usable_fold(F.col("doc_id"), folds, held)))
    return out.select("doc_id", F.coalesce(f == held, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
