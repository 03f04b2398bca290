"""Prefix trie against plain dictionaries over whole paths."""
import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm import queries, trie
from helpers import SF, same_as_oracle

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """rows: (conv_id, turn, role, text) with distinct or equal turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0,
                           hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(),
                           role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, cs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(cs) - 1) * (len(path[-1][1]) if path else 0)
    return sorted([cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()]
                  for p, cs in members.items())


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                          "ends_sha256"]
    return sorted(list(r) for r in df.collect())


def check(spark, rows, schema=SCHEMA):
    assert got(trie.nodes(trie.rebuilt(spark.createDataFrame(rows, schema)))) == brute([r[:4] for r in rows])


def test_query_matches_sql(spark):
    same_as_oracle(spark, "op13_prefix_trie")


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "conversations").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op13_prefix_trie"](spark, SF)) == brute(rows)


def test_edge_rows(spark):
    rows = [(c, t, "user", f"text {t % 3}") for c in (0, 1, 2, 5, 99, 100, 205, 317, -5, -100, -250) for t in range(7)]
    rows += [(3, None, None, None), (3, None, None, None), (3, 1, "", ""), (None, 1, "user", "x"), (4, 2, "user", "é👩"),
             (400, 0, "a", "b:c"), (401, 0, "ab", ":c"), (402, 0, "a", "b:c"), (-(2 ** 63), 0, "x", "y"),
             (2 ** 63 - 1, 0, "x", "y"), (4, 2, "user", "a"), (500, 1, "user", "long " * 100_000)]
    check(spark, rows)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("mine") for c in ("position", "chars", "turn_id", "PIECE", "key", "n")})
    assert got(trie.nodes(trie.rebuilt(clash))) == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert got(trie.nodes(trie.rebuilt(empty))) == []


def test_copies_and_common_beginnings(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(4)]
    rows += [(c, t, "user", f"same {t}" if t < 3 else f"own {c % 40} {t}") for c in range(300, 600) for t in range(6)]
    check(spark, rows)


@pytest.mark.parametrize("piece, strings", [(3, 4), (1, 2), (2, 1), (5, 50)])
def test_pieces_and_trees_of_any_size(spark, monkeypatch, piece, strings):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "STRINGS", strings)
    rows = [(c, t, "user", f"{t if t < 6 else c % 5}") for c in range(0, 330, 3) for t in range(c % 14 + 1)]
    rows += [(c, t, "user", f"{t if t < 4 else c % 2}") for c in range(1, 200, 9) for t in range(11)]
    check(spark, rows)


def test_layouts_grow_and_keep_order():
    import random
    for n in (3, 5, 17, 49, 200):
        root, keys = trie.Node(b""), random.Random(n).sample(range(256), n)
        for k in keys:
            trie.insert(root, bytes([k]) + b"rest", k)
        assert root.layout == next(s for s in (4, 16, 48, 256) if n <= s)
        assert [c.value for c in root.children()] == sorted(keys)
        assert all(root.child(k).value == k for k in keys)
        assert all(root.child(k) is None for k in set(range(256)) - set(keys))


def test_paths_are_compressed_and_part():
    root = trie.Node(b"")
    for key in (b"abcdef", b"abcxyz", b"abc", b"abcdefgh"):
        trie.insert(root, key, key)
    (abc,) = root.children()
    assert (abc.path, abc.value) == (b"abc", b"abc")
    assert [c.path for c in abc.children()] == [b"def", b"xyz"]
    assert [c.path for c in abc.children()[0].children()] == [b"gh"]
