"""Prefix trie of conversations by adaptive radix trees.

A turn gets an id of fixed width (the first WIDTH bytes, big-endian, of the
SHA-256 of its role and text), a conversation the ids of its turns joined, a
string of bytes.  Distinct strings are dealt by ranges, so many conversations
with a common beginning spread over tasks; a task puts a bounded number of
them at a time into an adaptive radix tree.  Its nodes hold 4, 16, 48 or 256
children in layouts that grow with them, and single-child paths are compressed.
Only byte depths that are whole turns are nodes of the trie.

What lies between the first and the last string of a tree is complete; the
nodes on these two paths may go on in a neighbour's tree.  Their counts are
added up afterwards, by the digest of their path.

Conversations of any length are cut into pieces of PIECE turns.  A piece that
goes on ends in a node below which another tree hangs, named by a digest of all
turns before it; trees are made from the lowest layer up, so the sums of a
layer are there when the layer above needs them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import common

#: Bytes of a turn id; turns of a piece; strings of one tree.
WIDTH, PIECE, STRINGS = 16, 512, 20_000
#: Turns that a conversation may take from another: fewer than this.
HEADS = 6
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- the tree ------------------------------------------------------------------
class Node:
    """A node: the compressed bytes that lead to it, the string that ends here,
    and its children by their first byte, in a layout that fits their number.

    Up to 4 and up to 16 children: sorted first bytes beside the children; up
    to 48: a table from byte to slot; more: a slot a byte."""

    __slots__ = ("path", "value", "layout", "keys", "below", "sums")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.sums = path, value, None
        self.layout, self.keys, self.below = 4, bytearray(), []

    def child(self, byte: int):
        if self.layout <= 16:
            i = bisect_left(self.keys, byte)
            return self.below[i] if i < len(self.keys) and self.keys[i] == byte else None
        if self.layout == 48:
            slot = self.keys[byte]
            return self.below[slot - 1] if slot else None
        return self.below[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or take another in its place."""
        if self.layout <= 16:
            i = bisect_left(self.keys, byte)
            if i < len(self.keys) and self.keys[i] == byte:
                self.below[i] = node
                return
            if len(self.keys) == self.layout:
                self.grow()
                return self.put(byte, node)
            self.keys.insert(i, byte)
            self.below.insert(i, node)
        elif self.layout == 48:
            if self.keys[byte]:
                self.below[self.keys[byte] - 1] = node
                return
            if len(self.below) == 48:
                self.grow()
                return self.put(byte, node)
            self.below.append(node)
            self.keys[byte] = len(self.below)
        else:
            self.below[byte] = node

    def grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            table = bytearray(256)
            for slot, byte in enumerate(self.keys):
                table[byte] = slot + 1
            self.layout, self.keys = 48, table
        else:
            full = [None] * 256
            for byte, slot in enumerate(self.keys):
                if slot:
                    full[byte] = self.below[slot - 1]
            self.layout, self.keys, self.below = 256, bytearray(), full

    def children(self) -> list[Node]:
        """In byte order."""
        if self.layout <= 16:
            return self.below
        if self.layout == 48:
            return [self.below[slot - 1] for slot in self.keys if slot]
        return [n for n in self.below if n]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a and b agree on `low` bytes, not on n
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def insert(root: Node, key: bytes, value) -> None:
    """Put a string into the tree; each string once."""
    node, at = root, 0
    while at < len(key):
        down = node.child(key[at])
        if down is None:
            node.put(key[at], Node(key[at:], value))
            return
        rest = key[at:at + len(down.path)]
        same = _common(down.path, rest)
        if same < len(down.path):  # the compressed path parts here
            fork = Node(down.path[:same])
            down.path = down.path[same:]
            fork.put(down.path[0], down)
            node.put(key[at], fork)
            down = fork
        node, at = down, at + same
    node.value = value


def _preorder(root: Node) -> list[tuple[Node, bytes]]:
    """Every node with the whole path to it; `sums` of each node filled with
    the members below, the smallest, and the characters of some string's turns."""
    order, stack = [], [(root, b"")]
    while stack:
        node, before = stack.pop()
        here = before + node.path
        order.append((node, here))
        stack += [(c, here) for c in reversed(node.children())]
    for node, _ in reversed(order):
        parts = [c.sums for c in node.children()]
        if node.value:
            parts.append((node.value["n"], node.value["least"], node.value))
        node.sums = (sum(p[0] for p in parts), min(p[1] for p in parts), parts[0][2])
    return order


def trie_rows(strings: list[dict], layer: int):
    """The whole-turn nodes of the tree of distinct strings, given in byte
    order: lists of values in the order of ROWS.  Nodes on the way to the first
    or the last string (`edge`) lack what edge nodes below them hold."""
    root = Node(b"")
    for s in strings:
        insert(root, s["key"], s)
    first, final = strings[0]["key"], strings[-1]["key"]
    waiting: dict[int, list] = {}  # tree node -> topmost trie rows below it
    rows = []
    for node, here in reversed(_preorder(root)):
        below = [r for c in node.children() for r in waiting.pop(id(c))]
        start = (len(here) - len(node.path)) // WIDTH + 1 if node is not root else 0
        n, least, some = node.sums
        for turns in range(len(here) // WIDTH, start - 1, -1):
            path = here[:turns * WIDTH]
            edge = first.startswith(path) or final.startswith(path)
            value = node.value if len(path) == len(here) else None
            whole = [r for r in below if not r["edge"]]
            row = {"edge": edge, "path": path, "turns": turns, "n": n, "conv_id": least, "parent": None,
                   "chars": some["chars"][turns - 1] if turns else 0, "ends": value and value["ends"],
                   "children": len(whole), "leaves": sum(r["leaves"] for r in whole),
                   "saved": sum(r["saved"] for r in whole)}
            if layer and turns == 1:  # a tree's root: its turns are the upper layer's
                row["conv_id"], row["chars"] = some["above"], 0
            if value and value["children"]:  # goes on in the lower layer
                for sums in ("children", "leaves", "saved"):
                    row[sums] += value[sums]
            if not edge:
                row["leaves"] = row["leaves"] or 1
                row["saved"] += (n - 1) * row["chars"]
            for r in below:
                r["parent"] = row
            below = [row]
            rows.append(row)
        waiting[id(node)] = below
    return rows


# ---- Spark ---------------------------------------------------------------------
ROWS = ("edge boolean, tree binary, depth long, conv_id long, n long, chars long, ends string, children long, "
        "leaves long, saved long, parent_conv_id long, digest binary, parent binary, path array<binary>")


def _digest(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:WIDTH]


def _trees(strings: DataFrame, layer: int) -> DataFrame:
    """The trie rows of a layer's distinct strings (see ROWS).  Edge rows have
    the digest of their path and of all paths above it; rows below an edge row
    its digest instead of its smallest member."""
    schema = pa.schema([("edge", pa.bool_()), ("tree", pa.binary()), *((c, pa.int64()) for c in (
        "depth", "conv_id", "n", "chars")), ("ends", pa.string()), *((c, pa.int64()) for c in (
            "children", "leaves", "saved", "parent_conv_id")), ("digest", pa.binary()), ("parent", pa.binary()),
        ("path", pa.list_(pa.binary()))])

    def record(row):
        turns, up = row["turns"], row["parent"]
        out = {k: row[k] for k in ("edge", "conv_id", "n", "chars", "ends", "children", "leaves", "saved")}
        out["depth"] = turns + (layer * PIECE - 1 if layer else 0)
        out["tree"] = row["path"] if layer and turns == 1 else None
        if up and not (layer and up["turns"] == 0):
            out["parent_conv_id"] = None if up["edge"] else up["conv_id"]
            out["parent"] = _digest(up["path"]) if up["edge"] else None
        if row["edge"]:
            out["digest"] = _digest(row["path"])
            out["path"] = [_digest(row["path"][:t * WIDTH]) for t in range(1 if layer else 0, turns + 1)]
        return out

    def emit(strings):
        rows = (r for r in trie_rows(strings, layer) if r["turns"] or not layer)
        while part := [record(r) for _, r in zip(range(5_000), rows)]:
            yield pa.RecordBatch.from_pylist(part, schema)

    def run(batches):
        held = []
        for batch in batches:
            for s in batch.to_pylist():
                held.append(s)
                if len(held) == STRINGS:
                    yield from emit(held)
                    held = []
        if held:
            yield from emit(held)

    return strings.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, ROWS)


def _layer(strings: DataFrame, layer: int) -> DataFrame:
    """The trie rows of a layer, whole: conv_id, depth, parent_conv_id, n,
    children, leaves, saved, ends, and `tree`, the name of the tree whose root
    the row is (the upper layer's node; null for all others)."""
    out = ["tree", "conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "ends"]
    rows = common.cut(_trees(strings, layer), "trees")
    # two paths a tree, the same node in several: one row a node
    edges = common.cut(rows.filter("edge").groupBy("digest").agg(
        *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.min("conv_id").alias("conv_id"),
        *(F.max(c).alias(c) for c in ("ends", "tree", "parent", "path")), F.max("depth").alias("depth"),
        F.max("chars").alias("chars")), "edges")
    more = edges.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(
        F.count(F.lit(1)).alias("more"))
    edges = edges.join(more, "digest", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    own = edges.select(F.explode("path").alias("digest"), F.expr("leaves + if(children = 0, 1, 0)").alias("leaves"),
                       F.expr("saved + (n - 1) * chars").alias("saved"))
    sums = own.groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = edges.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    edges = edges.drop("leaves", "saved").join(sums, "digest").join(above, "parent", "left")
    whole = rows.filter("NOT edge")
    return (edges.select(*out)
            .unionByName(whole.filter("parent IS NULL").select(*out))
            .unionByName(whole.filter("parent IS NOT NULL").drop("parent_conv_id").join(above, "parent").select(*out)))


def _pieces(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, piece, key, chars, through, last) with the pieces' number.
    `key` holds the turn ids, after a digest of all turns before the piece (none
    for the first); `through` is that digest with this piece's turns."""
    piece = F.expr(f"greatest(position - 1, 0) div {PIECE}")
    here = F.array_sort(F.collect_list(F.when(F.col("position") > 0, F.struct("position", "turn_id", "chars"))))
    pieces = turns.groupBy("conv_id", piece.alias("piece")).agg(here.alias("t")).select(
        "conv_id", "piece", F.unhex(F.array_join("t.turn_id", "")).alias("key"), F.col("t.chars").alias("chars"))
    pieces = common.cut(pieces, "pieces")
    layers = 1 + (pieces.agg(F.max("piece")).first()[0] or 0)
    if layers == 1:
        return pieces.withColumns({"through": F.lit(None).cast("binary"), "last": F.lit(True)}), 1
    order = Window.partitionBy("conv_id").orderBy("piece")
    digest = F.sha2(F.concat(F.col("piece").cast("string").cast("binary"), F.lit(b":"), "key"), 256)
    half = lambda at: F.bit_xor(F.conv(F.substr(digest, F.lit(at), F.lit(16)), 16, -10).cast("long")).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    through = F.unhex(F.concat(*(F.lpad(F.hex(half(at)), 16, "0") for at in (1, 17))))
    pieces = pieces.withColumn("through", through)
    return pieces.select(
        "conv_id", "piece", F.concat(F.coalesce(F.lag("through").over(order), F.lit(b"")), "key").alias("key"),
        F.when(F.col("piece") > 0, F.concat(F.array(F.lit(0)), "chars")).otherwise(F.col("chars")).alias("chars"),
        "through", F.lead("piece").over(order).isNull().alias("last")), layers


def _members(pieces: DataFrame) -> DataFrame:
    """(g, n, least, ends) of the conversations with an equal piece:
    their number, the smallest, and the SHA-256 of those that end with it.  A
    group is a stream of ids in one task, as the digest demands; it is held by
    nobody."""
    def run(batches):
        group, n, least, digest, ends = None, 0, None, None, False
        for batch in batches:
            out = []
            for g, conv_id, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if g != group:
                    if group is not None:
                        out.append((group, n, least, digest.hexdigest()))
                    group, n, least, digest, ends = g, 0, conv_id, hashlib.sha256(), False
                n += 1
                if last:
                    digest.update(f",{conv_id}".encode() if ends else str(conv_id).encode())
                    ends = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["g", "n", "least", "ends"])
        if group is not None:
            yield pa.RecordBatch.from_pydict({"g": [group], "n": [n], "least": [least], "ends": [digest.hexdigest()]})

    rows = pieces.select("g", "conv_id", "last")
    return rows.repartition("g").sortWithinPartitions("g", "conv_id").mapInArrow(
        run, "g string, n long, least long, ends string")


def nodes(turns: DataFrame) -> DataFrame:
    """One row a trie node of conversations given as conv_id, position (from 1;
    0: the conversation exists), turn_id (32 hex digits), chars: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    as the contract of the query has them.

    Positions of a conversation are distinct and without gaps.  Without a
    conversation there is no node, not even the root.
    """
    pieces, layers = _pieces(turns)
    group = F.substr(F.sha2(F.concat(F.col("piece").cast("string").cast("binary"), F.lit(b":"), "key"), 256),
                     F.lit(1), F.lit(32))
    pieces = pieces.withColumn("g", group)
    strings = pieces.join(_members(pieces).withColumnRenamed("least", "conv_id"), ["g", "conv_id"])
    strings = common.cut(strings.select("piece", "key", "chars", "through", "n", F.col("conv_id").alias("least"),
                                        "ends"), "strings")
    found, trees = [], None
    for layer in reversed(range(layers)):
        here = strings.filter(F.col("piece") == layer)
        if trees is None:
            here = here.select("*", *(F.lit(None).cast("long").alias(c) for c in ("children", "leaves", "saved")))
        else:
            here = here.join(trees, here.through == trees.tree, "left")
        if layer:
            name = F.substr("key", F.lit(1), F.lit(WIDTH))
            above = strings.filter(F.col("piece") == layer - 1).select(
                F.col("through").alias("name"), F.col("least").alias("above"))
            here = here.join(above, name == above.name)
        else:
            here = here.withColumn("above", F.lit(None).cast("long"))
        rows = _layer(here.select("key", "chars", "n", "least", "ends", "children", "leaves", "saved", "above"), layer)
        if layer:
            rows = common.cut(rows, "layer")
            trees = rows.filter("tree IS NOT NULL").select("tree", "children", "leaves", "saved")
        found.append(rows.filter("tree IS NULL"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"),
                      F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The turns of rebuilt conversations, as `nodes` takes them: the first h
    turns of conversation c - c % 100, then c's own after its first h, with h
    the crc32 of c in decimal, modulo 6.

    Turns are ordered by `turn`, nulls first, equal ones by their turn id, so
    repeated rows are turns of their own.  Null roles and texts count as empty;
    rows without a conv_id belong to no conversation; c % 100 has c's sign.
    Texts are digested whole; extra columns are ignored, whatever their names.
    """
    t = common.only(conversations, conv_id="long", turn="long", role="string", text="string").filter(
        "conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("conv_id", "turn", F.substr(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role",
                                                            "text").cast("binary"), 256), F.lit(1), F.lit(2 * WIDTH))
                 .alias("turn_id"), F.length("text").alias("chars"))
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_id")
    h = _taken(F.col("conv_id"))
    t = common.cut(t.select("conv_id", F.row_number().over(own).cast("long").alias("i"), "turn_id", "chars"), "turns")
    heads = t.filter(f"i < {HEADS} AND conv_id % 100 = 0").groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("i", "turn_id", "chars"))).alias("head"))  # fewer than HEADS
    convs = t.filter("i = 1").select("conv_id", F.expr("conv_id - conv_id % 100").alias("base"))
    convs = convs.join(heads, "base", "left").select("conv_id", F.slice(F.coalesce("head", F.array()), F.lit(1), h)
                                                     .alias("head"))
    rest = t.filter(F.col("i") > h).join(convs.select("conv_id", F.size("head").alias("n")), "conv_id").select(
        "conv_id", (F.col("i") - h + F.col("n")).cast("long").alias("position"), "turn_id", "chars")
    taken = convs.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.i").alias("position"), "t.turn_id", "t.chars")
    there = convs.select("conv_id", F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("turn_id"),
                         F.lit(None).cast("int").alias("chars"))
    return rest.unionByName(taken).unionByName(there)


def _taken(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")
