import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tickloom.llm import prefix_trie

TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *[T.StructField(x, T.StringType()) for x in ("c", "depth", "d1", "words", "n")]])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], TURN)


def digest(role, text):
    raw = hashlib.sha256(len(role.encode()).to_bytes(8, "little") + role.encode() + text.encode()).digest()
    return [int.from_bytes(raw[k : k + 8], "little", signed=True) for k in (0, 8)]


def plain(rows):
    """All nodes by walking every rebuilt conversation turn by turn."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - int(np.fmod(c, 20))
        built[c] = own.get(lender, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path]
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].replace("\t", " ").replace("\n", " ").split(" ")) if p and p[-1][1].strip() else 0 for p in below)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(path))
        parent = nodes[path[:-1]][0] if path else None
        out.append((members[0], len(path), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def result(spark, rows, **how):
    found = prefix_trie.trie(frame(spark, rows), **how)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in found.collect())


def conversations(n=70, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 130), n):
        length = rng.choice([1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a b", "c", "", None, "d e f"])) for t in range(length)]
    rows += [(500 + c, t, "user", "the same words") for c in range(30) for t in range(6)]  # copies
    rows += [(700, t, "user", f"turn {t % 3}") for t in range(300)]  # one long conversation
    return rows


ODD = [(1, None, "user", "null turn"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 5, None, None), (None, 1, "user", "no conversation"), (19, 1, "a", "b\tc"), (20, None, None, " "), (39, 0, "ab", "c"), (38, 0, "a", "bc")]


@pytest.mark.parametrize("how", [{}, {"limit": 4, "factor": 3, "shard": 5}])
def test_nodes_equal_a_walk(spark, how):
    rows = conversations()
    assert result(spark, rows, **how) == plain(rows)


def test_odd_rows_ties_and_turnless_conversations(spark):
    assert result(spark, ODD) == plain(ODD)
    assert result(spark, []) == []


def test_a_conversation_over_many_tasks(spark):
    rows = [(40, t, "user", f"turn {t * 7 % 13}") for t in range(400)] + [(41, t, "user", f"turn {t * 7 % 13}") for t in range(400)] + [(7, 0, "user", "x")]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else Spark joins the small ranges
    try:
        assert result(spark, rows, limit=50, factor=4) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_colliding_digests_are_noticed(spark):
    rows = [(20, 0, "u", "a"), (20, 1, "u", "b"), (40, 0, "u", "b"), (40, 1, "u", "a"), (60, 0, "u", "c")]
    assert result(spark, rows, all_bases=[(1, 1), *prefix_trie.BASES]) == plain(rows)  # base 1 forgets the order of turns
    with pytest.raises(RuntimeError):
        prefix_trie.trie(frame(spark, rows), all_bases=[(1, 1)])


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    depth = rng.integers(0, 9, 5000)
    table = prefix_trie.SlotTable(a, b, depth)
    assert sorted(table.slot) == list(range(5000))
    assert (table.find(a, b, depth) == table.slot).all()
    assert (table.find(a, b + np.uint64(1), depth) == -1).all()
    assert (prefix_trie.SlotTable(a[:0], b[:0], depth[:0]).find(a, b, depth) == -1).all()


def test_arithmetic_modulo_the_prime():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, prefix_trie.PRIME, 200).astype(np.uint64), rng.integers(0, prefix_trie.PRIME, 200).astype(np.uint64)
    a[0] = b[0] = prefix_trie.PRIME - 1
    assert prefix_trie.times(a, b).tolist() == [int(x) * int(y) % prefix_trie.PRIME for x, y in zip(a, b)]
    assert prefix_trie.minus(a, b).tolist() == [(int(x) - int(y)) % prefix_trie.PRIME for x, y in zip(a, b)]
    assert prefix_trie.power(12345, np.arange(50)).tolist() == [pow(12345, k, prefix_trie.PRIME) for k in range(50)]
