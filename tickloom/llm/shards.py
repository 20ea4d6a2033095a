"""Sharding by a k-d tree over document metadata, with DataFrame expressions only.

A node holding several shards is split along its widest dimension (length, source, language, id; each scaled to
the whole table) at the weighted median, where weights are bytes. Medians are found by histograms: rows are
counted by the leading bits of their sort key, running sums pick in every open node the bucket where the bytes cross
the wanted share, and the next pass refines there. The driver reads one row per open node and pass, and sends the
decisions back as a table of one row per open node, so its work grows with the leaves and not with the rows.

The sort key is (scaled value, checksum of the text, hash of the row), and equal texts (same bytes and checksum)
share the least metadata of their group, so they lie side by side. A group that weighs no more than a shard's even
share is never cut: where the median falls inside it, it goes whole to the side that has room and the median is
looked for again among the other rows. Only a group too heavy for one shard is cut, by the hash of its rows. Leaves
are reached when a node holds one shard of the target bytes.

Rows: null texts weigh one byte; null metadata counts as the least value; repeated rows are all placed; an empty
table gives an empty one; other columns are ignored. Slots are numbered without gaps from 0 in every shard.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.session import materialize

BITS = 16  # a histogram has at most 2**BITS buckets per open node
KEY_BITS = 62
TOLERANCE = 0.008  # of a shard's even share: how far from the wanted bytes a cut may fall
TRIES = 6  # groups that one cut may move whole to a side before the nearest cut beside a group is taken
HOT_GROUPS = 2_000  # groups of copies with more than this part of all rows are sent to every task; so at most as many
NODES_SENT = 100_000  # decisions on up to so many nodes, at about 100 bytes each, are sent to every task
ROWS_PER_SLOT_GROUP = 20_000


def _measures(docs: DataFrame) -> list[Column]:
    """Length, source, language and id as numbers; names are placed by their checksum."""
    have = set(docs.columns)
    text_code = lambda c: F.crc32(F.col(c).cast("string").cast("binary")).cast("double") if c in have else F.lit(None).cast("double")
    return [F.log1p(F.coalesce(F.length("text"), F.lit(0))).cast("double"), text_code("source"), text_code("lang"), F.col("doc_id").cast("double")]


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, size, checksum, sort keys by dimension, hash of the row."""
    measures = _measures(docs)
    names = [f"m{k}" for k in range(len(measures))]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), *[m.alias(n) for m, n in zip(measures, names)]), "shard-meta"
    )
    group = ["text_crc32", "size"]
    shared = materialize(rows.groupBy(group).agg(F.count(F.lit(1)).alias("copies"), *[F.min(n).alias(n) for n in names]), "shard-groups")
    many = F.col("copies") * HOT_GROUPS > (shared.agg(F.sum("copies")).first()[0] or 0)
    # the few hot groups go to every task, so that no task gets all copies of a text
    slim = rows.select("doc_id", *group).join(F.broadcast(shared.where(many)), group, "left")
    rest = slim.where("copies is null").select("doc_id", *group).join(shared.where(~many), group)
    rows = materialize(slim.where("copies is not null").unionByName(rest), "shard-meta")
    bounds = rows.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()

    def key(n: str) -> Column:
        low, high = bounds[f"lo_{n}"], bounds[f"hi_{n}"]
        scaled = F.lit(0).cast("long") if low is None or high == low else F.coalesce(F.floor((F.col(n) - low) / (high - low) * float(2**30 - 1)), F.lit(0)).cast("long")
        return F.shiftleft(scaled, 32) + F.col("text_crc32")

    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", *names), 64 - KEY_BITS)
    keyed = rows.select("doc_id", "size", "text_crc32", *[key(n).alias(f"k{k}") for k, n in enumerate(names)], tie.alias("tie"), F.lit(0).alias("node"))
    return materialize(keyed, "shard-level")  # the passes over the first node read keys instead of making them again


def _with(rows: DataFrame, decisions: list[dict], schema: str, how: str = "inner") -> DataFrame:
    """``rows`` with what was decided on their node."""
    table = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(decisions)), f"array<struct<node: int, {schema}>>")))
    return rows.join(F.broadcast(table) if len(decisions) <= NODES_SENT else table, "node", how)


def _key(rows: DataFrame) -> Column:
    """A row's sort key along the dimension ``dim`` of its node."""
    return F.element_at(F.array(*[c for c in rows.columns if c[0] == "k" and c[1:].isdigit()]), F.col("dim") + 1)


def _choose(rows: DataFrame, nodes: list[int], dims: int) -> dict[int, tuple[int, int]]:
    """Widest dimension and bytes of every node in ``nodes``; the earlier dimension wins a tie."""
    top = lambda k: F.shiftright(F.col(f"k{k}"), 32)
    here = _with(rows, [{"node": n, "open": True} for n in nodes], "open: boolean")
    found = here.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(top(k)) - F.min(top(k))).alias(f"w{k}") for k in range(dims)]).collect()  # a row per open node
    return {r["node"]: (max(range(dims), key=lambda k: (r[f"w{k}"], -k)), r["bytes"]) for r in found}


class Cut:
    """The search for one node's cut: where it stands, and the best cut so far."""

    def __init__(self, node: int, dim: int, weight: int, want: int):
        self.node, self.dim, self.need, self.room = node, dim, want, weight - want
        self.lefts: list[int] = []  # keys of whole groups that go left, and right, whatever the cut
        self.rights: list[int] = []
        self.best: dict | None = None
        self.miss = math.inf
        self.restart()

    def restart(self):
        self.part, self.key, self.prefix, self.left, self.before = 0, 0, 0, 0, 0

    def asked(self) -> dict:
        return {"node": self.node, "dim": self.dim, "part": self.part, "key": self.key, "prefix": self.prefix, "left": self.left, "step": min(BITS, KEY_BITS - self.left), "need": self.need - self.before, "placed": self.lefts + self.rights}

    def take(self, key: int, tie: int, miss: float):
        if miss < self.miss:
            self.miss, self.best = miss, {"node": self.node, "dim": self.dim, "key": key, "tie": tie, "lefts": list(self.lefts), "rights": list(self.rights)}

    def step(self, found, slack: float, whole: float) -> bool:
        """Go on from the bucket where the bytes cross what is needed (None: no rows are left). True when done."""
        if found is None or self.need <= self.before:
            self.take(self.key, 0, abs(self.need - self.before))
            return True
        bucket, weight, total = found["bucket"], found["bytes"], found["total"] + self.before
        prior = total - weight
        bits = min(BITS, KEY_BITS - self.left)
        shift = KEY_BITS - self.left - bits
        edge = bucket if self.need - prior <= total - self.need else bucket + 1
        miss = min(self.need - prior, abs(total - self.need))
        if miss <= slack or shift == 0:
            self.take(*((self.key, edge << shift) if self.part else (edge << shift, 0)), miss)
        if miss <= slack or (shift == 0 and self.part):
            return True
        if shift:
            self.prefix, self.left, self.before = bucket, self.left + bits, prior
            return False
        if weight > whole:  # one group of equal texts that no shard can hold: cut it by the rows' hashes
            self.part, self.key, self.prefix, self.left, self.before = 1, bucket, 0, 0, prior
            return False
        if len(self.lefts) + len(self.rights) == TRIES:
            return True
        if weight <= self.need and (2 * (self.need - prior) >= weight or weight > self.room):
            self.lefts.append(bucket)
            self.need -= weight
        elif weight <= self.room:
            self.rights.append(bucket)
            self.room -= weight
        else:
            return True
        self.restart()
        return False


def _cuts(rows: DataFrame, cuts: list[Cut], slack: float, whole: float) -> list[dict]:
    """(key, tie) below which a row of a node goes left, and the groups that go left or right whole. The left side
    then holds the wanted bytes to within ``slack``, or as near as groups of up to ``whole`` bytes allow."""
    open_ = {c.node: c for c in cuts}
    while open_:
        asked = _with(rows, [c.asked() for c in open_.values()], "dim: int, part: int, key: long, prefix: long, left: int, step: int, need: long, placed: array<long>")
        asked = asked.withColumn("k", _key(rows))
        asked = asked.where(~F.array_contains("placed", F.col("k")) & ((F.col("part") == 0) | (F.col("k") == F.col("key"))))
        asked = asked.withColumn("v", F.when(F.col("part") == 0, F.col("k")).otherwise(F.col("tie")))
        asked = asked.where(F.expr(f"left = 0 or shiftright(v, {KEY_BITS} - left) = prefix"))
        counted = asked.groupBy("node", "need", F.expr(f"shiftright(v, {KEY_BITS} - left - step)").alias("bucket")).agg(F.sum("size").alias("bytes"))
        # at most 2**BITS buckets a node
        running = counted.withColumn("total", F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        place = F.struct("bucket", "bytes", "total")
        crossed = running.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("total") >= F.col("need"), place)), F.max(place)).alias("at"))
        found = {r["node"]: r["at"] for r in crossed.collect()}  # a row per open node
        open_ = {n: c for n, c in open_.items() if not c.step(found.get(n), slack, whole)}
    return [c.best for c in cuts]


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot). Give the number of shards, or the bytes each leaf should hold.
    A node is named by its first shard."""
    rows = metadata(docs)
    dims = sum(c[0] == "k" for c in rows.columns)
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    all_bytes, count = total[0] or 0, total[1]
    leaves = shards or max(1, math.ceil(all_bytes / (target_bytes or max(all_bytes, 1))))
    holds = {0: leaves}
    even = all_bytes / leaves
    while count and any(h > 1 for h in holds.values()):
        open_ = {n: h for n, h in holds.items() if h > 1}
        seen = _choose(rows, list(open_), dims)
        cuts = _cuts(rows, [Cut(n, dim, weight, weight * (open_[n] // 2) // open_[n]) for n, (dim, weight) in seen.items()], tolerance * even, even)
        for n, h in open_.items():
            holds[n], holds[n + h // 2] = h // 2, h - h // 2
        moves = [{"node": c["node"], "dim": c["dim"], "key": c["key"], "cut": c["tie"], "lefts": c["lefts"], "rights": c["rights"], "right": c["node"] + open_[c["node"]] // 2} for c in cuts]
        decided = _with(rows, moves, "dim: int, key: long, cut: long, lefts: array<long>, rights: array<long>, right: int", "left").withColumn("k", _key(rows))
        below = F.expr("array_contains(lefts, k) or (not array_contains(rights, k) and (k < key or (k = key and tie < cut)))")
        rows = materialize(decided.select(*[F.when(F.col("right").isNull() | below, F.col("node")).otherwise(F.col("right")).alias("node") if c == "node" else F.col(c) for c in rows.columns]), "shard-level")
    placed = rows.withColumn("shard", F.col("node").cast("int"))
    groups = max(1, math.ceil(count / ROWS_PER_SLOT_GROUP))
    placed = placed.withColumn("part", F.pmod(F.col("tie"), F.lit(groups)).cast("int"))
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32")
    numbered = placed.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"))
