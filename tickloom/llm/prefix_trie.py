"""Prefix trie of rebuilt conversations: one row per node, from distinct prefix digests and flat arrays per shard.

Every conversation c takes its first h = crc32(c as decimal text) mod 4 turns from conversation c - c % 20 (all of
its turns if it has fewer, none if it is absent) and goes on with its own turns after its first h. Two conversations
share a depth-d node when their first d turns agree in role and text; the textless root has depth 0.

How it is computed:

* A turn becomes a SHA-256 and a word count in its first task; texts move no further. Turns are sorted by range over
  (conversation, turn), so a conversation of any length spreads over many tasks; each task numbers its rows and sums
  t_i B^i modulo 2^61 - 1 for two bases. Such sums of parts combine, so a conversation that crosses tasks is completed
  from one row a task, and a prefix that was moved to another depth is a multiplication.
* Distinct (digest, depth) are the nodes. They are verified: all rows of a node must agree on the other half of the last
  turn's SHA-256 and on the parent's digest. If any do not, the whole is done again with other bases.
* Nodes of one conversation hang below the first such node as a chain and need no trie. All others are dealt to
  shards: a subtree of at most ``LIMIT`` prefix rows is never cut. Larger nodes form tiers of ``FACTOR`` times the limit
  each, worked on in turn with the sums of the subtrees below them, so no shard grows with the table.
* A shard enumerates its digests with a minimal perfect hash (levels of bit tables, a slot is a rank), stores the digests
  at their slots, finds each node's parent slot by a lookup that is compared with the stored digest, scatters counts
  into arrays and adds them through the parent slots, deepest first.
* ``ends_sha256`` is one running hash over a node's ids in order; ids are sorted by range and packed to long strings in many
  tasks, so what is hashed one after the other is few rows, read as a stream.

Equal turn numbers of a conversation stand in the order of their SHA-256; a null turn number stands first. Null roles
and texts are empty. Rows with a null conv_id belong to no conversation and are left out. Negative ids keep their sign in
c % 20. Repeated rows are turns of their own. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import _WHITE, map_slices, mix, small
from tickloom.session import materialize

PRIME = (1 << 61) - 1
BASES = [(0x1B5AD2C96E37F481, 0x0C3F17A94D86B25E), (0x17E9A3D5C2084F6B, 0x1250B8E46F9D3A77), (0x0A64F3819C7DE52B, 0x1F02C6B75E8A943D)]
LIMIT = 100_000  # prefix rows below a node that goes to one shard whole
FACTOR = 10_000  # from one tier of larger nodes to the next
SHARD = 50_000  # nodes of a shard, about
LENDER = 20  # a conversation borrows from the last id divisible by this
BORROWED = 4  # 0 to 3 turns
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
PACK = 4096  # ids in one packed string

_P = np.uint64(PRIME)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


# ---- arithmetic modulo 2^61 - 1 ----


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return reduced(reduced(np.uint64(2) * (a1 * b1)) + reduced((mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31))) + reduced(a0 * b0))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduced(a + (_P - b))


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    out, factor, rest = np.ones(len(exponents), np.uint64), base % PRIME, exponents.astype(np.int64)
    while rest.any():
        out = np.where(rest & 1 == 1, times(out, np.full(len(out), factor, np.uint64)), out)
        factor, rest = factor * factor % PRIME, rest >> 1
    return out


def running(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Prefix sums modulo the prime, begun anew at every run (``starts``: the first place of each row's run)."""
    low = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values & _LOW31, dtype=np.uint64)))
    high = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values >> np.uint64(31), dtype=np.uint64)))
    at = np.arange(1, len(values) + 1)
    return reduced(reduced(low[at] - low[starts]) + times(reduced(high[at] - high[starts]), np.full(len(values), 1 << 31, np.uint64)))


def _unsigned(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---- turns, their places and sums ----

_TURN = "c long, turn long, t1 long, t2 long, v1 long, v2 long, words long"
_PLACED = "border boolean, part int, c long, i long, s1 long, s2 long, t1 long, t2 long, v1 long, v2 long, words long"


def _turn_digests(part: pa.RecordBatch) -> dict:
    role, text = ([x or b"" for x in part.column(i).cast(pa.binary()).to_pylist()] for i in (2, 3))
    digest = np.frombuffer(b"".join(hashlib.sha256(len(r).to_bytes(8, "little") + r + t).digest() for r, t in zip(role, text)), dtype="<i8").reshape(-1, 4)
    data = np.frombuffer(b" ".join([*text, b""]), dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in text])))
    word = ~_WHITE[data]
    first = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    words = np.bincount(np.searchsorted(begins, first, side="right") - 1, minlength=len(text))[: len(text)]
    return {"c": part.column(0), "turn": part.column(1), "t1": digest[:, 0], "t2": digest[:, 1], "v1": digest[:, 2], "v2": digest[:, 3], "words": words}


def _placed(batches, bases):
    """Sorted turns of one task: place and sums within the task, and a border row for its first and last conversation."""
    part = TaskContext.get().partitionId()
    carry, edges = None, {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        c = np.asarray(batch.column(0))
        n = len(c)
        new = np.concatenate(([True], c[1:] != c[:-1]))
        starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        goes_on = (starts == 0) if carry and carry[0] == c[0] else np.zeros(n, bool)
        i = np.arange(n) - starts + 1 + np.where(goes_on, carry[1] if carry else 0, 0)
        sums = []
        for k, base in enumerate(bases):
            s = running(times(reduced(_unsigned(batch.column(2 + k))), power(base, i)), starts)
            sums.append(np.where(goes_on, reduced(s + np.uint64(carry[2 + k] if carry else 0)), s))
        carry = (int(c[-1]), int(i[-1]), int(sums[0][-1]), int(sums[1][-1]))
        head = edges.setdefault("first", (int(c[0]), 0, 0, 0))
        mine = np.flatnonzero(c == head[0])
        if len(mine):
            at = int(mine[-1])
            edges["first"] = (head[0], int(i[at]), int(sums[0][at]), int(sums[1][at]))
        yield _placed_batch(n, False, part, c, i, sums, [batch.column(k) for k in range(2, 7)])
    if carry:
        rows = [edges["first"]] + ([carry] if carry[0] != edges["first"][0] else [])
        c, i, a, b = (np.array(x) for x in zip(*rows))
        yield _placed_batch(len(rows), True, part, c, i, [a.astype(np.uint64), b.astype(np.uint64)], [pa.nulls(len(rows), pa.int64())] * 5)


def _placed_batch(n, border, part, c, i, sums, rest):
    arrays = [pa.array([border] * n), pa.array(np.full(n, part, np.int32)), pa.array(c), pa.array(i), _signed(sums[0]), _signed(sums[1]), *rest]
    return pa.RecordBatch.from_arrays(arrays, names=["border", "part", "c", "i", "s1", "s2", "t1", "t2", "v1", "v2", "words"])


def _offsets(rows: pa.Table, bases) -> pa.Table:
    """What lies before each later task of one conversation: one row a task comes in."""
    rows = rows.sort_by("part")
    n, sums, out = 0, [0, 0], []
    for r in rows.to_pylist():
        out.append((r["c"], r["part"], n, *sums))
        sums = [(sums[k] + pow(bases[k], n, PRIME) * r[f"s{k + 1}"]) % PRIME for k in (0, 1)]
        n += r["i"]
    c, part, before, o1, o2 = zip(*out)
    return pa.table({"c": pa.array(c, pa.int64()), "part": pa.array(part, pa.int32()), "before": pa.array(before, pa.int64()), "o1": pa.array(o1, pa.int64()), "o2": pa.array(o2, pa.int64())})


def _moved(batches, bases):
    names = ["c", "i", "s1", "s2", "t1", "t2", "v1", "v2", "words"]
    for b in batches:
        before = np.asarray(b.column("before"))
        out = {k: b.column(k) for k in names}
        out["i"] = pa.array(np.asarray(b.column("i")) + before)
        for k, base in enumerate(bases):
            out[f"s{k + 1}"] = _signed(reduced(_unsigned(b.column(f"o{k + 1}")) + times(power(base, before), _unsigned(b.column(f"s{k + 1}")))))
        yield pa.RecordBatch.from_arrays([out[k] for k in names], names=names)


def _numbered(turns: DataFrame, bases) -> DataFrame:
    """(c, i, s1, s2, t1, t2, v1, v2, words): place and prefix sums of every turn of its conversation."""
    ordered = turns.repartitionByRange("c", "turn", "t1", "t2").sortWithinPartitions("c", "turn", "t1", "t2")
    rows = materialize(ordered.mapInArrow(partial(_placed, bases=bases), _PLACED), "trie-places")
    edge = rows.where("border").select("c", "part", "i", "s1", "s2")
    several = edge.groupBy("c").agg(F.count(F.lit(1)).alias("tasks")).where("tasks > 1").select("c")
    before = small(edge.join(several, "c").groupBy("c").applyInArrow(lambda t: _offsets(t, bases), "c long, part int, before long, o1 long, o2 long"), "trie-before")
    rows = rows.where("not border").drop("border")
    if before.isEmpty():
        return rows.drop("part")
    full = rows.join(before, ["c", "part"], "left").fillna(0, ["before", "o1", "o2"]).drop("part")
    return materialize(full.mapInArrow(partial(_moved, bases=bases), "c long, i long, s1 long, s2 long, t1 long, t2 long, v1 long, v2 long, words long"), "trie-numbered")


# ---- rebuilt paths ----

_PATH = "c long, depth long, d1 long, d2 long, p1 long, p2 long, v1 long, v2 long, words long, rest long"


def _own_rows(batches, bases):
    """Digests of a conversation's own turns, moved to the depth they have after the borrowed ones."""
    back = [np.array([pow(base, -k, PRIME) for k in range(BORROWED)], np.uint64) for base in bases]
    names = [f.split()[0] for f in _PATH.split(", ")]
    for b in batches:
        shift = np.asarray(b.column("h")) - np.asarray(b.column("hb"))
        i = np.asarray(b.column("i"))
        out = {k: b.column(k) for k in ("c", "v1", "v2", "words")}
        for k, base in enumerate(bases, start=1):
            here, cut, lent = (_unsigned(b.column(f"{x}{k}")) for x in ("s", "cut", "lent"))
            term = times(reduced(_unsigned(b.column(f"t{k}"))), power(base, i))
            for name, s in (("d", here), ("p", minus(here, term))):
                out[f"{name}{k}"] = _signed(reduced(lent + times(back[k - 1][shift], minus(s, cut))))
        depth = i - shift
        out["depth"], out["rest"] = pa.array(depth), pa.array(np.asarray(b.column("total")) - depth)
        yield pa.RecordBatch.from_arrays([out[k] for k in names], names=names)


def _paths(turns: DataFrame, bases) -> tuple[DataFrame, DataFrame]:
    """Prefix rows of all rebuilt conversations, and (c, total) of each, turnless ones too."""
    rows = _numbered(turns, bases)
    lent = range(1, BORROWED)
    heads = [F.max(F.when(F.col("i") == k, F.col(x))).alias(f"{x}_{k}") for k in lent for x in ("s1", "s2", "v1", "v2", "words")]
    convs = materialize(rows.groupBy("c").agg(F.max("i").alias("n"), *heads), "trie-conversations")
    base = convs.where(F.col("c") % LENDER == 0).select(F.col("c").alias("b"), F.col("n").alias("n_b"), *[F.col(x).alias(f"b_{x}") for x in convs.columns if x not in ("c", "n")])
    h = F.crc32(F.col("c").cast("string").cast("binary")) % BORROWED

    def kth(name, n):
        return F.coalesce(*[F.when(F.col(n) == k, F.col(f"{name}_{k}")) for k in lent], F.lit(0))

    info = convs.withColumn("b", F.col("c") - F.col("c") % LENDER).join(base, "b", "left").withColumn("h", h).withColumn("hb", F.least("h", F.coalesce("n_b", F.lit(0))))
    info = info.withColumn("total", F.col("hb") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    info = materialize(info.withColumns({f"cut{k}": kth(f"s{k}", "h") for k in (1, 2)} | {f"lent{k}": kth(f"b_s{k}", "hb") for k in (1, 2)}), "trie-rebuilt")
    own = rows.join(info.where("n > h").select("c", "h", "hb", "total", "cut1", "cut2", "lent1", "lent2"), "c").where("i > h").mapInArrow(partial(_own_rows, bases=bases), _PATH)

    def pick(name):
        return kth(f"b_{name}", "depth")

    first = info.where("hb > 0").withColumn("depth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("hb").cast("long")))).withColumn("above", F.col("depth") - 1)
    first = first.select("c", "depth", pick("s1").alias("d1"), pick("s2").alias("d2"), kth("b_s1", "above").alias("p1"), kth("b_s2", "above").alias("p2"), pick("v1").alias("v1"), pick("v2").alias("v2"), pick("words").alias("words"), (F.col("total") - F.col("depth")).alias("rest"))
    return materialize(own.union(first), "trie-paths"), info.select("c", "total")


# ---- the node table of a shard ----


class SlotTable:
    """Minimal perfect hash of distinct (a, b, depth): slots 0 to n - 1; ``find`` gives -1 for what it does not hold."""

    def __init__(self, a, b, depth):
        self.levels, left, base = [], np.arange(len(a)), 0
        slot = np.empty(len(a), np.int64)
        while len(left):
            seed, width = len(self.levels) + 1, 2 * len(left) + 1
            at = self._place(a[left], b[left], depth[left], seed, width)
            alone = np.bincount(at, minlength=width) == 1
            rank = base + np.cumsum(alone) - 1
            placed = alone[at]
            slot[left[placed]] = rank[at[placed]]
            self.levels.append((seed, width, alone, rank))
            left, base = left[~placed], base + int(placed.sum())
            if seed > 200:
                raise ValueError("digests repeat")
        self.slot = slot
        self.stored = tuple(self._scatter(x) for x in (a, b, depth))

    @staticmethod
    def _place(a, b, depth, seed, width):
        return (mix(mix(mix(a + np.uint64(seed)) ^ b) + depth.astype(np.uint64)) % np.uint64(width)).astype(np.int64)

    def _scatter(self, values):
        out = np.empty_like(values)
        out[self.slot] = values
        return out

    def find(self, a, b, depth):
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for seed, width, alone, rank in self.levels:
            at = self._place(a[left], b[left], depth[left], seed, width)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        held = out >= 0
        for mine, x in zip(self.stored, (a, b, depth)):
            held &= np.where(out >= 0, mine[np.maximum(out, 0)] == x if len(mine) else False, False)
        return np.where(held, out, -1)


_NODE_IN = ["d1", "d2", "depth", "p1", "p2", "conv_id", "n_convs", "words", "ends", "chain", "more_children", "more_leaves", "more_saved"]
_NODE_OUT = "d1 long, d2 long, depth long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, ends long, n_children long, n_leaves long, saved_tokens long"


def _accumulate(nodes: pa.Table) -> pa.Table:
    """Children, leaves and saved words of a shard's nodes, through parent slots, deepest nodes first."""
    col = {k: nodes[k].to_numpy() for k in _NODE_IN}
    a, b, pa_, pb = (col[k].view(np.uint64) if col[k].flags.c_contiguous else np.ascontiguousarray(col[k]).view(np.uint64) for k in ("d1", "d2", "p1", "p2"))
    table = SlotTable(a, b, col["depth"])
    n, slot = len(a), table.slot

    def by_slot(values):
        out = np.empty_like(values)
        out[slot] = values
        return out

    parent = by_slot(table.find(pa_, pb, col["depth"] - 1))
    flat = {k: by_slot(v) for k, v in col.items()}
    children = flat["chain"] + flat["more_children"]
    held = parent >= 0
    children += np.bincount(parent[held], minlength=n)
    leaves = np.where(children == 0, 1, flat["chain"] + flat["more_leaves"])
    saved = (flat["n_convs"] - 1) * flat["words"] + flat["more_saved"]
    order = np.argsort(-flat["depth"], kind="stable")
    edges = np.flatnonzero(np.diff(flat["depth"][order])) + 1
    for level in np.split(order, edges):
        up = level[parent[level] >= 0]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    above = pa.array(flat["conv_id"][np.maximum(parent, 0)], mask=~held)
    out = {k: pa.array(flat[k]) for k in ("d1", "d2", "depth", "p1", "p2", "conv_id")} | {"parent_conv_id": above, "n_convs": pa.array(flat["n_convs"]), "ends": pa.array(flat["ends"])}
    return pa.table(out | {"n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved)})


# ---- hashes of the ids that end at a node ----


def _pack(batches):
    """Sorted (d1, d2, depth, c): runs of one node as strings of up to ``PACK`` ids."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(4)]
        new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)))
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        cut = np.flatnonzero((np.arange(n) - start) % PACK == 0)
        text = cols[3].astype(str).tolist()
        ids = [",".join(text[x:y]) for x, y in zip(cut.tolist(), [*cut[1:].tolist(), n])]
        yield pa.RecordBatch.from_arrays([*[pa.array(x[cut]) for x in cols], pa.array(ids, pa.string())], names=["d1", "d2", "depth", "c", "ids"])


def _hashed_ends(batches):
    """Sorted packed strings of whole nodes: one SHA-256 a node, carried from batch to batch."""
    node, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([state.hexdigest()])], names=["d1", "d2", "depth", "sha"])

    for batch in batches:
        out = {"d1": [], "d2": [], "depth": [], "sha": []}
        for *key, ids in zip(*[batch.column(k).to_pylist() for k in ("d1", "d2", "depth", "ids")]):
            if key == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                for name, x in zip(out, [*node, state.hexdigest()]):
                    out[name].append(x)
            node, state = key, hashlib.sha256(ids.encode())
        if out["sha"]:
            yield pa.RecordBatch.from_arrays([*[pa.array(out[k], pa.int64()) for k in ("d1", "d2", "depth")], pa.array(out["sha"])], names=list(out))
    if node is not None:
        yield done()


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    ends = materialize(paths.where("rest = 0").select("d1", "d2", "depth", "c").union(convs.where("total = 0").select(zero, zero, zero, "c")), "trie-ends")
    key = ["d1", "d2", "depth", "c"]
    packed = ends.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_pack, "d1 long, d2 long, depth long, c long, ids string")
    return packed.repartition("d1", "d2", "depth").sortWithinPartitions(*key).mapInArrow(_hashed_ends, "d1 long, d2 long, depth long, sha string")


# ---- the whole ----


def _nodes(paths: DataFrame) -> DataFrame:
    agree = [(F.min(x) == F.max(x)) for x in ("p1", "p2", "v1", "v2", "words")]
    sums = [F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")]
    sums += [F.sum((F.col("rest") == 0).cast("long")).alias("ends"), F.sum(F.col("rest") + 1).alias("size"), (agree[0] & agree[1] & agree[2] & agree[3] & agree[4]).alias("agree")]
    return materialize(paths.groupBy("d1", "d2", "depth").agg(*sums), "trie-nodes")


def _verified(turns: DataFrame, all_bases) -> tuple[DataFrame, DataFrame, DataFrame]:
    for bases in all_bases:
        paths, convs = _paths(turns, bases)
        nodes = _nodes(paths)
        if nodes.where("not agree").isEmpty():
            return paths, convs, nodes
    raise RuntimeError("prefix digests collide under every base")


def trie(conversations: DataFrame, limit: int = LIMIT, factor: int = FACTOR, shard: int = SHARD, all_bases=BASES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    rows = conversations.select(*[F.col(f"`{a}`").cast(t).alias(b) for a, t, b in (("conv_id", "long", "c"), ("turn", "long", "turn"), ("role", "string", "role"), ("text", "string", "text"))]).where("c is not null")
    turns = materialize(map_slices(rows, _turn_digests, _TURN), "trie-turns")
    paths, convs, nodes = _verified(turns, all_bases)
    alone = nodes.where("n_convs = 1")
    start = alone.groupBy("conv_id").agg(F.min("depth").alias("from"))
    alone = materialize(alone.join(start, "conv_id").withColumn("chain", F.when(F.col("ends") == 0, 1).otherwise(0).cast("long")), "trie-chains")
    sha_one = F.when(F.col("ends") > 0, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA)
    zero = F.lit(0).cast("long")
    tail = alone.where(F.col("depth") > F.col("from")).select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", F.col("chain").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), sha_one.alias("ends_sha256"))

    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.sum((F.col("total") == 0).cast("long")).alias("ends"), F.sum("total").alias("below")).where("n_convs > 0")
    root = root.select(zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", zero.alias("words"), "ends", zero.alias("chain"), (F.col("below") + F.col("n_convs")).alias("size"))
    names = root.columns
    shared = nodes.where("n_convs > 1").withColumn("chain", zero).select(names)
    stubs = alone.where(F.col("depth") == F.col("from")).withColumn("size", zero).select(names)
    tree = materialize(shared.union(stubs), "trie-shared")
    large = small(tree.where(F.col("size") > limit).select("d1", "d2", "depth", "conv_id", "size"), "trie-large")
    key, more = ["d1", "d2", "depth"], ["more_children", "more_leaves", "more_saved"]
    below = tree.limit(0).select(*key, *[zero.alias(x) for x in more])
    top, floor, done = large.agg(F.max("size")).first()[0] or 0, -1, []
    while True:
        tier = tree.where((F.col("size") > floor) & (F.col("size") <= limit))
        shards = max(1, -(-tier.count() // shard))
        place = F.shiftleft("depth", 31) + F.pmod(F.xxhash64("d1", "d2"), F.lit(shards))
        rest = paths.join(large.where(F.col("size") > limit).select(key), key, "left_anti")
        of_conv = rest.groupBy("c").agg(F.min(place).alias("place")).select(F.col("c").alias("conv_id"), F.col("place").bitwiseAND((1 << 31) - 1).alias("shard"))
        dealt = tier.join(of_conv, "conv_id").join(below, key, "left").fillna(0, more)
        found = materialize(dealt.groupBy("shard").applyInArrow(_accumulate, _NODE_OUT), "trie-tier")
        done.append(found)
        up = found.where("parent_conv_id is null").select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias(more[0]), F.col("n_leaves").alias(more[1]), F.col("saved_tokens").alias(more[2]))
        waiting = below.join(found.select(key), key, "left_anti")
        below = materialize(up.union(waiting).groupBy(key).agg(*[F.sum(x).alias(x) for x in more]), "trie-below")
        if top <= limit:
            break
        floor, limit = limit, limit * factor
    at_root = below.where("depth = 0").select(more)
    top_row = root.join(at_root, F.lit(True), "left").fillna(0, more).select("d1", "d2", "depth", "p1", "p2", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "ends", F.col(more[0]).alias("n_children"), F.greatest(F.lit(1), F.col(more[1])).alias("n_leaves"), F.col(more[2]).alias("saved_tokens"))
    done.append(top_row)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    parents = large.select(*key, "conv_id").union(root.select(*key, "conv_id")).select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("large_parent"))
    out = out.join(parents, ["p1", "p2", "depth"], "left").join(_ends(paths, convs), ["d1", "d2", "depth"], "left")
    above = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "large_parent")).alias("parent_conv_id")
    inner = out.select("conv_id", "depth", above, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return inner.union(tail)
