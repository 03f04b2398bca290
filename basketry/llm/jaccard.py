"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles, each a 64-bit hash.  Documents
are compared inside size bands.  In a band with k parts every shingle flips
one bit of a sketch: part floor(hash * k / 2**64), and in it one of 2**64
places.  Two sketches differ in at most as many bits as the sets differ in
shingles, and sets with Jaccard similarity 3/4 or more differ in at most
D = (n + m) / 7.  So at most D parts differ (pigeonhole), and of a document's
first D + c non-empty parts at least c are equal in any partner and stand
among the partner's first ones too.  Only those parts' fingerprints (the xor
over their bits of a hash per bit) are shuffled and joined on.

Equal sets are one node, so exact copies cost one row.  Fingerprints shared
by more than RUN nodes are hot (copies of one text, passages that many texts
share).  A pair must share as many fingerprints as its sets' sizes promise,
hot ones included; most pairs are dropped by that count alone.  A node with
fewer than c hot fingerprints needs none of them.  The other nodes, few, are
compared among each other once more, on all their parts in a new global order,
rare parts first, so that shared passages come last and are not reached.  What
is hot even then (near copies) is compared in rounds: one hub per fingerprint
against all, then more, in the last round every pair, but only of nodes in
different components by then.  All rounds compare whole sketches, of two bits
per shingle, first: a pair whose sketches differ in more bits than D is no
match.  The nodes of a large fingerprint are dealt in blocks: hubs go to each of
its blocks, and in the last round a group is a pair of blocks, so a task holds
few nodes at a time, however many share the fingerprint, and emits few pairs.

Every candidate pair is verified on the exact shingle sets, first each node's
best partner, then only pairs between components.  No link between components
is lost, and no stage emits all pairs of a group.

Hot fingerprints are split at the map side: a task's own hot runs go to any
partition, and only a mark goes to the fingerprint's.  Everything between
stages is written to the checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.components import components
from basketry.session import release
from basketry.llm import common

N = 5
#: Bands [4**i, 4**(i+1)); below SMALL every shingle is a part of its own.
BASE, SMALL = 4, 64
#: Parts per shingle of the band's largest set.
PARTS = 0.5
#: Fingerprints beyond D: a share of the band's smallest set, MORE at most.
MORE = 24
#: Nodes of a hot fingerprint that are compared with the others, by round: each
#: round connects most of what the next would otherwise emit; None is all.
HUBS = (1, 4, 16, None)
#: Bytes of sketches of one fingerprint in one block, about.
BLOCK = 32_000_000
#: Nodes a task in stages over nodes or links, and tasks of such a stage at least.
NODES, TASKS = 50_000, 12
#: Bits of a whole sketch per shingle of the band's largest set.
BITS = 2
#: Nodes that may share a fingerprint before it counts as hot.
RUN = 16
#: Fingerprints that a task sorts and sends together.
FLUSH = 400_000
#: Ids of candidate documents that are broadcast (8 bytes each); beyond it
#: their texts are found by a shuffled join.
BROADCAST_IDS = 1_000_000
MARK = np.iinfo(np.int64).min
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    """word -> 64-bit hash; remembers up to LIMIT words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: Words, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, lower-cased in
    A-Z; of the whole sequence if it has fewer words; empty without words."""
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, U)
    a = np.fromiter(map(words.__getitem__, w), U, len(w))
    size = min(n, len(a))
    h = np.full(len(a) - size + 1, size, U)
    for i in range(size):
        h = (h * U(0x9E3779B97F4A7C15)) ^ mix(a[i:i + len(h)] + U(i))
        h = mix(h)
    return np.unique(h)


def node_of(grams: np.ndarray) -> int:
    """64-bit identity of a set; never MARK."""
    return max(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63), MARK + 1)


def band(n: int) -> int:
    return (n.bit_length() - 1) // 2


def surplus(scheme: int) -> int:
    low = BASE**scheme
    return max(1, min(MORE, low * 3 // 5 if low < SMALL else low * 3 // 10))


def schemes(n: int):
    """(scheme, D): the band of the set, and the next one if a partner 4/3 as
    large can stand there."""
    b = band(n)
    most = n * 4 // 3
    yield b, (n + min(most, BASE**(b + 1) - 1)) // 7
    if most >= BASE**(b + 1):
        yield b + 1, (n + most) // 7


def fingerprints(grams: np.ndarray, scheme: int, d: int, single: bool,
                 want: int | None = None) -> tuple[np.ndarray, int]:
    """The fingerprints of the first D + c (or `want`) non-empty parts, and how
    many of them every partner shares at least."""
    want = d + surplus(scheme) if want is None else want
    if single or BASE**(scheme + 1) <= SMALL:
        part, z = grams[:want], mix(grams[:want])
    else:
        k = U(int(BASE**(scheme + 1) * PARTS))
        at = ((grams >> U(32)) * k) >> U(32)
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        stop = start[want] if len(start) > want else len(grams)
        start = start[:want]
        part, z = at[start], np.bitwise_xor.reduceat(mix(grams[:stop]), start)
    keys = mix(z ^ mix(part + U((scheme + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)))
    return keys, len(keys) - d


def sketch(grams: np.ndarray, scheme: int) -> np.ndarray:
    """The parity sketch of a set, as 64-bit words: each shingle flips one bit,
    so two sketches differ in at most as many bits as their sets in shingles."""
    bits = max(64, BITS * BASE**(scheme + 1))
    at = (mix(grams ^ U(0xA5A5A5A5A5A5A5A5)) % U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).view(U)


def runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    new = np.ones(len(sorted_by[0]) + 1, bool)
    if len(sorted_by[0]):
        new[1:-1] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
        return np.flatnonzero(new)
    return np.zeros(1, int)


EMITTED = ("kind byte, part int, doc_id long, node long, n int, scheme int, spare int, "
           "spare_up int, keys binary, nodes binary")
ARROW = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("doc_id", pa.int64()),
                   ("node", pa.int64()), ("n", pa.int32()), ("scheme", pa.int32()),
                   ("spare", pa.int32()), ("spare_up", pa.int32()), ("keys", pa.binary()),
                   ("nodes", pa.binary())])
DOC, CHUNK, HOT = 0, 1, 2


def record(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
         for f in ARROW], schema=ARROW)


def emitter(buckets: int, single: bool, n: int):
    """Map side: rows of kind DOC (one a document), CHUNK (fingerprints and
    nodes of one part) and HOT (runs found hot here)."""
    def flush(held):
        keys, nodes, scheme = (np.concatenate(x) for x in zip(*held))
        held.clear()
        part = scheme * buckets + ((keys >> U(32)) % U(buckets)).astype(np.int64)
        full = (part.astype(U) << U(32)) | (keys & U(0xFFFFFFFF))
        order = np.lexsort((nodes, full))
        full, nodes = full[order], nodes[order]
        keep = runs(full, nodes)[:-1]  # copies within the task
        full, nodes = full[keep], nodes[keep]
        at = runs(full)
        size = np.diff(at)
        hot = np.repeat(size > RUN, size)
        if hot.any():
            first = at[:-1][size > RUN]
            chunks = 1 + int(hot.sum()) // 100_000
            for k, (f, v) in enumerate(zip(np.array_split(full[hot], chunks),
                                           np.array_split(nodes[hot], chunks))):
                yield record(1, kind=[HOT], part=[int(v[0]) & 0x7FFFFFFF], keys=[f.tobytes()],
                             nodes=[v.tobytes()])
            nodes = nodes.copy()
            nodes[first] = MARK
            hot[first] = False
            full, nodes = full[~hot], nodes[~hot]
        part = (full >> U(32)).astype(np.int64)
        at = runs(part)
        low = full.astype("<u4")
        yield record(len(at) - 1, kind=[CHUNK] * (len(at) - 1), part=part[at[:-1]],
                     keys=[low[i:j].tobytes() for i, j in zip(at[:-1], at[1:])],
                     nodes=[nodes[i:j].tobytes() for i, j in zip(at[:-1], at[1:])])

    def run(batches):
        words, held, size = Words(), [], 0
        for batch in batches:
            for piece, texts in common.slices(batch, 1, 500_000):
                info = []
                for doc_id, text in zip(piece.column(0).to_pylist(), texts):
                    g = shingles(text, words, n)
                    if not len(g):
                        info.append((None, 0, None, None, None))
                        continue
                    node, spare = node_of(g), [None, None]
                    for i, (scheme, d) in enumerate(schemes(len(g))):
                        keys, spare[i] = fingerprints(g, scheme, d, single)
                        if doc_id is not None:
                            held.append((keys, np.full(len(keys), node), np.full(len(keys), scheme)))
                            size += len(keys)
                    info.append((node, len(g), band(len(g)), *spare))
                node, count, scheme, spare, up = zip(*info)
                yield record(len(info), kind=[DOC] * len(info),
                             part=[(x or 0) & 0x7FFFFFFF for x in node], doc_id=piece.column(0),
                             node=node, n=count, scheme=scheme, spare=spare, spare_up=up)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


JOINED = ("kind byte, doc_id long, node long, n int, scheme int, spare int, spare_up int, "
          "key long, other long")
JOINED_ARROW = pa.schema([("kind", pa.int8()), *[(f, pa.int64() if f in ("doc_id", "node") else pa.int32())
                          for f in ("doc_id", "node", "n", "scheme", "spare", "spare_up")],
                          ("key", pa.int64()), ("other", pa.int64())])
PAIR, SHARED = 1, 2


def joined(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
         for f in JOINED_ARROW], schema=JOINED_ARROW)


def in_pieces(kind: int, size: int = 100_000, **columns):
    total = len(next(iter(columns.values())))
    for i in range(0, total, size):
        cols = {k: v[i:i + size] for k, v in columns.items()}
        m = len(next(iter(cols.values())))
        yield joined(m, kind=np.full(m, kind, np.int8), **cols)


def counted(*columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The distinct rows of some columns (lists of arrays), and how often each
    occurs."""
    cols = [np.concatenate([np.empty(0, np.int64), *c]) for c in columns]
    order = np.lexsort(cols)
    cols = [c[order] for c in cols]
    at = runs(*cols)
    return *[c[at[:-1]] for c in cols], np.diff(at)


def matcher(buckets: int):
    """Reduce side: DOC rows as they are; per fingerprint its pairs of nodes
    (PAIR, n times in a scheme, summed over the partition), or its members if
    it is hot (SHARED).  A partition holds whole parts."""
    def run(batches):
        full, nodes = [], []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            docs = batch.filter(pa.array(kind == DOC))
            if docs.num_rows:
                yield joined(docs.num_rows, kind=docs.column(0), **{
                    f: docs.column(f) for f in ("doc_id", "node", "n", "scheme", "spare", "spare_up")})
            for i in np.flatnonzero(kind == HOT).tolist():
                k = np.frombuffer(batch.column(8)[i].as_py(), np.int64)
                yield from in_pieces(SHARED, key=k, node=np.frombuffer(
                    batch.column(9)[i].as_py(), np.int64),
                    scheme=((k >> 32) // buckets).astype(np.int32))
            for i in np.flatnonzero(kind == CHUNK).tolist():
                low = np.frombuffer(batch.column(8)[i].as_py(), "<u4").astype(U)
                full.append(low | (U(batch.column(1)[i].as_py()) << U(32)))
                nodes.append(np.frombuffer(batch.column(9)[i].as_py(), np.int64))
        if not full:
            return
        full, nodes = np.concatenate(full), np.concatenate(nodes)
        order = np.lexsort((nodes, full))
        full, nodes = full[order], nodes[order]
        keep = runs(full, nodes)[:-1]
        full, nodes = full[keep], nodes[keep]
        at = runs(full)
        start, size = at[:-1], np.diff(at)
        hot = (size > RUN) | (nodes[start] == MARK)
        members = np.repeat(hot, size) & (nodes != MARK)
        key = full[members].astype(np.int64)
        yield from in_pieces(SHARED, key=key, node=nodes[members],
                             scheme=((key >> 32) // buckets).astype(np.int32))
        left, right, scheme = [], [], []
        of = ((full[start] >> U(32)) // U(buckets)).astype(np.int64)
        for m in range(2, RUN + 1):
            at = np.flatnonzero(~hot & (size == m))
            i, j = np.triu_indices(m, 1)
            rows = nodes[start[at][:, None] + np.arange(m)]
            left.append(rows[:, i].ravel())
            right.append(rows[:, j].ravel())
            scheme.append(np.repeat(of[at], len(i)))
        a, b, scheme, times = counted(left, right, scheme)
        yield from in_pieces(PAIR, node=a, other=b, scheme=scheme, n=times)

    return run


#: Sides of a group that a row of `dealt` is on; a group that is no larger than
#: a block has all its rows on both.
BOTH, LEFT, RIGHT = 0, 1, 2


def dealt(open_nodes: DataFrame, hubs: int | None) -> DataFrame:
    """Rows (key, i, j, side, node, n, component, sketch) by group (key, i, j).
    A fingerprint whose sketches fill no more than BLOCK bytes is one group.
    The nodes of a larger one are dealt in blocks of about that size: its first
    `hubs` nodes go to every block as its left side, or, without `hubs`, each
    pair of blocks is a group with one of them as its left side."""
    large = open_nodes.groupBy("key").agg(F.sum(F.length("sketch")).alias("_size")).filter(
        F.col("_size") > BLOCK).select("key", F.ceil(F.col("_size") / BLOCK).cast("int").alias("_blocks"))
    large = common.cut(large, "jaccard-large", TASKS)
    out, n_large = ["key", "i", "j", "side", "node", "n", "component", "sketch"], large.count()
    whole = lambda df: df.select("*", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(BOTH).alias("side"))
    if not n_large:
        rows = whole(open_nodes).select(out)
    else:
        if n_large <= BROADCAST_IDS:
            large = F.broadcast(large)  # two numbers a row
        nodes = open_nodes.join(large, "key").withColumn(
            "_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        if hubs:
            rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
            first = nodes.select("key", "node", rank.alias("_rank")).filter(F.col("_rank") <= hubs)
            left = nodes.join(first.select("key", "node"), ["key", "node"], "left_semi").select(
                "*", F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("j"))
            right = nodes.select("*", F.lit(-1).alias("i"), F.col("_block").alias("j"))
        else:
            left = nodes.select("*", F.col("_block").alias("i"),
                                F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("j"))
            right = nodes.select("*", F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("i"),
                                 F.col("_block").alias("j"))
        rows = whole(open_nodes.join(large, "key", "left_anti")).select(out).unionByName(
            left.withColumn("side", F.lit(LEFT)).select(out)).unionByName(
            right.withColumn("side", F.lit(RIGHT)).select(out))
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def near_pairs(hubs: int | None):
    """Of `dealt` rows: a, b, shared for the nodes on a group's left side (of a
    whole group the first `hubs`, or all) and all on its right side of another
    component whose size and sketch can be similar; with the number of
    fingerprints, summed over some groups.  A group is held at a time, and the
    pairs found since the last ones went."""
    def run(batches):
        found, held, group, now = [], 0, [], None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)))
            rows = zip(*(batch.column(c).to_pylist() for c in range(3, 8)))
            for key, row in zip(keys, rows):
                if key != now:
                    held += compare(group, now, hubs, found)
                    if held > 1_000_000:
                        yield from flush(found)
                        held = 0
                    group, now = [], key
                group.append(row)
        compare(group, now, hubs, found)
        yield from flush(found)

    return run


def compare(group: list, key: tuple | None, hubs: int | None, found: list) -> int:
    """Add a group's pairs, the smaller node first, to `found`; their number."""
    if len({r[3] for r in group}) < 2:  # one component, or nothing
        return 0
    left = [r for r in group if r[0] != RIGHT]
    right = [r for r in group if r[0] != LEFT]
    if hubs and key[2] < 0:
        left = left[:hubs]
    node, n, comp = (np.array([r[k] for r in right], np.int64) for k in (1, 2, 3))
    bits = np.stack([np.frombuffer(r[4], U) for r in right])
    same = key[1] in (-1, key[2])  # of nodes on both sides each pair once
    total = 0
    for _, a, size, of, own in left:
        near = (comp != of) & (4 * np.minimum(n, size) >= 3 * np.maximum(n, size))
        at = np.flatnonzero(near & (node > a) if same else near)
        if len(at):
            differ = np.bitwise_count(bits[at] ^ np.frombuffer(own, U)).sum(axis=1, dtype=np.int64)
            other = node[at[differ <= (n[at] + size) // 7]]
            found.append((np.minimum(other, a), np.maximum(other, a)))
            total += len(other)
    return total


def flush(found: list):
    """The pairs found so far, counted, as batches; `found` is then empty."""
    a, b, shared = counted([x for x, _ in found], [x for _, x in found])
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 100_000]) for x in (a, b, shared)], names=["a", "b", "shared"])
    found.clear()


class Verifier:
    """Verifies candidate pairs of nodes on the exact sets."""

    def __init__(self, docs: DataFrame, info: DataFrame, n: int):
        self.docs, self.info, self.n = docs, info, n
        # tasks of stages over nodes or links, as many as the nodes ask for
        self.tasks = max(TASKS, info.count() // NODES)

    def grams(self, nodes: DataFrame) -> DataFrame:
        """node -> its set, from the text of one document of it."""
        known = common.cut(nodes.join(self.info, "node").select("doc_id").coalesce(self.tasks).distinct(),
                           "jaccard-ids", self.tasks)
        n, ids = self.n, known
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)

        def run(batches):
            words = Words()
            for batch in batches:
                for _, texts in common.slices(batch, 1, 500_000):
                    sets = [shingles(t, words, n) for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node_of(g) for g in sets], pa.int64()),
                         pa.array([g.tobytes() for g in sets], pa.binary())], names=["node", "grams"])

        # several rows of one id or one set give equal rows; links() is distinct
        sets = self.docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "node long, grams binary")
        sets = common.cut(sets, "jaccard-sets")
        common.drop(known)
        return sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) -> the distinct pairs with 4 * intersection >= 3 * union."""
        p = common.cut(pairs.select("a", "b").distinct(), "jaccard-pairs", self.tasks)
        g = self.grams(p.select(F.explode(F.array("a", "b")).alias("node")).distinct())

        def run(batches):
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= 75 * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

        both = p.join(g.withColumnsRenamed({"node": "a", "grams": "x"}), "a").select("a", "b", "x")
        both = both.join(g.withColumnsRenamed({"node": "b", "grams": "y"}), "b").select("a", "b", "x", "y")
        links = common.cut(both.mapInArrow(run, "a long, b long"), "jaccard-links")
        common.drop(p, g)
        return links

    def parts(self, nodes: DataFrame, single: bool) -> DataFrame:
        """(node) -> key, node, scheme, d: all non-empty parts in all schemes; and
        for each node and scheme one row without a key and with the sketch."""
        ids = common.cut(nodes.join(self.info, "node").select("doc_id"), "jaccard-ids", self.tasks)
        n = self.n
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)

        def run(batches):
            words = Words()
            for batch in batches:
                for _, texts in common.slices(batch, 1, 500_000):
                    for g in (shingles(t, words, n) for t in texts):
                        for scheme, d in schemes(len(g)) if len(g) else ():
                            keys, _ = fingerprints(g, scheme, d, single, len(g))
                            m = len(keys) + 1
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([*keys.astype(np.int64).tolist(), None], pa.int64()),
                                 pa.array(np.full(m, node_of(g))),
                                 pa.array(np.full(m, scheme, np.int32)), pa.array(np.full(m, d, np.int32)),
                                 pa.array([None] * (m - 1) + [sketch(g, scheme).tobytes()], pa.binary())],
                                names=["key", "node", "scheme", "d", "sketch"])

        return self.docs.join(ids, "doc_id", "left_semi").mapInArrow(
            run, "key long, node long, scheme int, d int, sketch binary")


class Linked:
    """The components that the links found so far make."""

    def __init__(self, verify: Verifier):
        self.verify = verify
        self.comp = verify.info.select("node", F.col("node").alias("component"))

    def add(self, links: DataFrame) -> None:
        """Join components by new links: of those only their components matter,
        so a round is as large as its links, not as all links."""
        a, b = (self.comp.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "ab")
        new = common.cut(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
                         .filter("a <> b").coalesce(self.verify.tasks).distinct(), "jaccard-new", self.verify.tasks)
        if new.limit(1).count():
            joined = components(new).select(F.col("node").alias("component"), F.col("component").alias("into"))
            before = self.comp
            self.comp = common.cut(before.join(joined, "component", "left").select(
                "node", F.coalesce("into", "component").alias("component")), "jaccard-classes", self.verify.tasks)
            if hasattr(before, "scratch_folder"):  # not the first, of single nodes
                common.drop(before)
        common.drop(links, new)
        release(self.comp.sparkSession)

    def connect(self, pairs: DataFrame) -> None:
        """(a, b, shared): verify each node's best partner, then what is left
        between components."""
        tasks = self.verify.tasks
        pairs = common.cut(pairs, "jaccard-candidates", tasks)
        best = None
        for one, other in (("a", "b"), ("b", "a")):
            top = pairs.groupBy(one).agg(F.max(F.struct("shared", other)).alias("x")).select(
                one, F.col(f"x.{other}").alias(other)).select("a", "b")
            best = top if best is None else best.union(top)
        self.add(self.verify.links(best))
        left = common.cut(across(pairs, self.comp), "jaccard-across", tasks)
        if left.limit(1).count():
            self.add(self.verify.links(left))
        common.drop(pairs, left)


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose nodes are not yet in one component."""
    a = comp.withColumnsRenamed({"node": "a", "component": "ca"})
    b = comp.withColumnsRenamed({"node": "b", "component": "cb"})
    return pairs.join(a, "a").join(b, "b").filter("ca <> cb").select("a", "b")


def compare_hot(verify: Verifier, linked: Linked, hot: DataFrame, single: bool) -> None:
    """Compare the hot nodes with each other, rare parts first."""
    found = common.cut(verify.parts(hot, single), "jaccard-parts")
    # rows that repeat an id bring their parts twice
    parts = found.filter("key IS NOT NULL").select("key", "node", "scheme", "d").distinct()
    sketches = found.filter("key IS NULL").dropDuplicates(["node", "scheme"]).select(
        "node", "scheme", "sketch")
    often = parts.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("often"))
    # a window holds one node's parts in one scheme
    order = Window.partitionBy("node", "scheme").orderBy("often", "key")
    first = (parts.join(often.filter("often > 1"), F.col("key") == F.col("of"), "left")
             .withColumn("often", F.coalesce("often", F.lit(1)))
             .withColumn("at", F.row_number().over(order))
             .filter("at <= d + 1 AND often > 1").select("key", "node", "scheme"))
    first = common.cut(first.join(verify.info.select("node", "n"), "node"), "jaccard-first")
    for hubs in HUBS:
        c = first.join(linked.comp, "node")
        open_ = c.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter(
            "x <> y").select("key")
        c = common.cut(c.join(open_, "key", "left_semi").join(sketches, ["node", "scheme"])
                       .select("key", "node", "n", "component", "sketch"), "jaccard-open", verify.tasks)
        if not c.limit(1).count():
            break
        pairs = dealt(c, hubs).mapInArrow(near_pairs(hubs), "a long, b long, shared long")
        linked.connect(pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared")))
        common.drop(c)
    common.drop(found, first)


def near_duplicates(docs: DataFrame, n: int = N) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null and blank texts have no shingle and are linked with nothing.  Rows
    with a null id get their set's size and no component, and link nothing.
    Repeated rows are copies of each other.  Extra columns are ignored; an
    empty table gives an empty result.
    """
    d = common.small_batches(common.only(docs, doc_id="long", text="string"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def matched(single: bool) -> DataFrame:
        sent = d.mapInArrow(emitter(buckets, single, n), EMITTED).repartition("part")
        return common.cut(sent.mapInArrow(matcher(buckets), JOINED), "jaccard")

    single = False
    m = matched(single)
    spares = F.least("spare", F.coalesce("spare_up", "spare"))
    if m.filter(F.col("kind") == DOC).filter(spares < 1).limit(1).count():
        # a sketch with too few non-empty parts to promise a match (practically
        # never): all sets again, with every shingle a part of its own
        single = True
        m = matched(single)
    doc = m.filter(F.col("kind") == DOC)
    info = common.cut(doc.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "jaccard-nodes")
    verify = Verifier(d, info, n)
    linked = Linked(verify)
    # what is sent of a node in a scheme: its size, how many fingerprints, and
    # how many of them any partner shares at least
    sent = doc.filter("node IS NOT NULL AND doc_id IS NOT NULL").select("node", "n", F.explode(F.array(
        F.struct("scheme", "spare"),
        F.struct((F.col("scheme") + 1).alias("scheme"), F.col("spare_up").alias("spare")))).alias("s"))
    most = F.least(F.floor(F.col("n") * 4 / 3), F.pow(F.lit(BASE), F.col("s.scheme") + 1) - 1)
    sent = (sent.filter("s.spare IS NOT NULL").select(
        "node", "n", "s.scheme", "s.spare",
        (F.col("s.spare") + F.floor((F.col("n") + most) / 7)).alias("e"))
        .dropDuplicates(["node", "scheme"]))
    member = m.filter(F.col("kind") == SHARED).select("key", "node", "scheme").distinct()
    member = common.cut(member, "jaccard-members")
    held = member.groupBy("node", "scheme").agg(F.count(F.lit(1)).alias("held"))
    sent = common.cut(sent.join(held, ["node", "scheme"], "left").fillna(0, ["held"]), "jaccard-sent")
    side = lambda x: sent.select(
        F.col("node").alias(x), "scheme", *[F.col(c).alias(c + x) for c in ("n", "e", "held")])
    pairs = m.filter(F.col("kind") == PAIR).groupBy(
        F.col("node").alias("a"), F.col("other").alias("b"), "scheme").agg(F.sum("n").alias("shared"))
    # sets that differ in d shingles share all but d of the shorter list
    linked.connect(
        pairs.join(side("a"), ["a", "scheme"]).join(side("b"), ["b", "scheme"])
        .filter("4 * least(na, nb) >= 3 * greatest(na, nb) AND "
                "shared + least(helda, heldb) >= least(ea, eb) - floor((na + nb) / 7)")
        .groupBy("a", "b").agg(F.max("shared").alias("shared")))
    # nodes with as many hot fingerprints as some pair may share at least
    promised = sent.groupBy("scheme").agg(F.min("spare").alias("least"))  # a row a scheme
    hot = common.cut(sent.join(F.broadcast(promised), "scheme").filter("held >= least")
                     .select("node").distinct(), "jaccard-hot")
    if hot.limit(1).count():
        compare_hot(verify, linked, hot, single)
    # from nodes to documents: a component is named by its smallest id
    comp = linked.comp
    named = (info.join(comp, "node").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = comp.join(named, "component").select(F.col("node").alias("of_node"), "component_id")
    return doc.select("doc_id", "n", "node").join(
        named, (F.col("node") == F.col("of_node")) & F.col("doc_id").isNotNull(), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = N) -> DataFrame:
    """The rows of `docs`, all columns as they are, but of each component only
    the document of its smallest id.

    Rows with a null id and documents without a word all stay; rows that
    repeat an id and its text are one document.
    """
    found = common.cut(near_duplicates(docs, n), "jaccard-result")
    drop = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    again = common.cut(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again")),
        "jaccard-again")
    drop = common.cut(drop, "jaccard-dropped")
    if drop.count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    kept = docs.join(drop, F.col("`doc_id`") == F.col("_dropped"), "left_anti")
    if not again.limit(1).count():
        return kept
    on = F.col("`doc_id`") == F.col("_again")
    return kept.join(again, on, "left_anti").union(
        kept.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"]))
