"""Exact Jaccard self-join of shingle sets by partitioning the universe, for sets of any size.

Two sets of a similar size that reach the threshold differ in at most H elements. Elements are hashed into
segments; which segmentation holds depends on the band of sizes the larger set is in, so a set is indexed under
its own band and, if a partner there is possible, under the next one. If all segments are given weight 1 and
there are H + 1 of them, a linked pair agrees on one whole segment; a segment of weight 2 counts as agreeing
with one difference and is found by its one-deletion neighbourhood. The allocation is by cost: for every band
the cheaper of (a) whole segments with ``spare`` extra ones, and (b) segments of weight 2, from the number of index
entries and of chance agreements expected. With ``spare`` extra segments a linked pair agrees on spare + 1 of
them, so every set may leave out its ``spare`` costliest entries, as long as all sets rank them alike: empty
segments come first, then entries by how many texts have them. What is left out are segments that unrelated texts
share, such as those filled by one common passage. Both ways are exact.

What shares an index entry with an entry's hub (its least set) is compared by sketches first: the parities of two to
four buckets a shingle, so that two sets differ in at least as many shingles as their sketches do in bits. Pairs whose
sketches differ by more than a link allows are no links; a spanning forest of the others makes families, so that texts
with one common passage are no family, however many they are. A family's distinct sets are fetched once, dealt by size
into blocks of bounded size, and every pair of blocks that can hold a link is counted exactly in a task of its own; a
task returns a spanning forest of its links. Nothing is capped.

Rows: a null or empty text has an empty set and is linked with nothing; texts of fewer than k words are one
shingle; equal sets are one class, whatever the ids; null ids and repeated rows are kept; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import distinct_by_owner, keyed_text, map_slices, mix, shingles_of, slices, small
from tickloom.llm.graph import components, with_roots
from tickloom.session import materialize

RATIO = 1.5  # of the largest to the least size in a band
BLOCK = 1024  # sets compared with each other in a task, twice that for two blocks
BLOCK_SHINGLES = 1_000_000  # and about so many shingles
BROADCAST_ROWS = 500_000  # rows of three numbers that may be sent to every task
SEEN = 200_000  # texts a task remembers, so that copies are indexed once
LEAST_BITS, MOST_BITS = 64, 1 << 20  # of a sketch; beyond, sketches tell less apart and lose nothing
CROWD, FEW = 4096, 64  # sets whose sketches are compared in a task, twice that for two blocks; fewer share a task with others
SKETCH_BYTES = 16 << 20  # of sketches in a task, or sent to every task
_SALT = np.uint64(0xA24BAED4963EE407)


class Rule:
    """Jaccard threshold num / den over k-word shingles, and what follows from it."""

    def __init__(self, k: int, num: int, den: int, rows: int):
        self.k, self.num, self.den, self.rows = k, num, den, max(rows, 1)
        self.low = [1]

    def _next(self) -> None:
        self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * max(RATIO, self.den / self.num))))

    def band(self, size: int) -> int:
        while self.low[-1] <= size:
            self._next()
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def views(self, size: int) -> list[int]:
        """Bands under which a set is indexed: its own, and the next one if a set there can be similar."""
        own = self.band(size)
        while len(self.low) < own + 3:
            self._next()
        return [own, own + 1] if size * self.den >= self.num * self.low[own + 1] else [own]

    @lru_cache(maxsize=None)
    def plan(self, band: int) -> tuple[int, int, int]:
        """(weight, segments, spare) of a band, by expected cost."""
        while len(self.low) < band + 2:
            self._next()
        low, high = self.low[band], self.low[band + 1] - 1
        budget = 2 * high * (self.den - self.num) // (self.den + self.num) + 1
        peers = self.rows / 12
        best = None
        for spare in range(0, 3 + budget // 2):
            m = budget + spare
            empty = m * math.exp(-low / m)
            term, below = math.exp(-empty), 0.0
            for i in range(spare + 1):
                below += term
                term *= empty / (i + 1)
            risky = max(1.0 - below, 0.0)
            cost = m + peers * risky * risky
            if best is None or cost < best[0]:
                best = (cost, (1, m, spare))
        m = (budget + 1) // 2
        t = low / m
        cost = high + m + peers * m * (math.exp(-t) * (1 + t)) ** 2
        return best[1] if best[0] <= cost else (2, m, 0)

    def linked(self, shared, a, b):
        return self.den * shared >= self.num * (a + b - shared)

    def possible(self, differ, a, b):
        """Whether sets of sizes a and b that differ in ``differ`` elements or more can be linked."""
        return (self.den + self.num) * differ <= (self.den - self.num) * (a + b)


def entries(tokens: np.ndarray, size: int, rule: Rule) -> list[tuple[int, int, np.ndarray]]:
    """(view, how many more entries may be left out, index entries) of one set, for each of its views."""
    out = []
    for band in rule.views(size):
        weight, m, spare = rule.plan(band)
        salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        segment = (mix(tokens ^ salt) % np.uint64(m)).astype(np.int64)
        value = mix(tokens + _SALT)
        order = np.argsort(segment, kind="stable")
        at = np.searchsorted(segment[order], np.arange(m + 1))
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)))
        sums = running[at[1:]] - running[at[:-1]]
        names = mix(np.arange(m, dtype=np.uint64) + salt)
        if weight == 1:
            keep = at[1:] > at[:-1]
            empty = np.flatnonzero(~keep)
            keep[empty[spare:]] = True  # empty segments are left out first, in their order
            out.append((band, max(spare - len(empty), 0), mix(sums[keep] * np.uint64(3) ^ names[keep])))
        else:
            whole, without = mix(sums * np.uint64(3) ^ names), mix((sums[segment] - value) * np.uint64(3) ^ names[segment])
            out.append((band, 0, np.unique(np.concatenate((whole, without)))))
    return out


def sketches(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of every set (hashes ``h`` between the offsets ``at``) the parities of its elements by their lowest bits. The
    number of buckets is a power of two, so a sketch folded in half is the narrower sketch of the same set."""
    n = np.diff(at)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    to = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.where(n > 0, bits, 0))))
    place = np.repeat(to[:-1], n) + (h & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(to[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((to[:-1] // 8).tolist(), (to[1:] // 8).tolist())]


def shingle_sets(df: DataFrame, rule: Rule) -> DataFrame:
    """(id, th, n, s1, s2, sketch): size and two independent sums of the set's hashes; equal sums mean equal sets."""

    def run(part: pa.RecordBatch):
        h, _, owner = shingles_of(part.column("text"), rule.k)
        n = part.num_rows
        h, at = distinct_by_owner(h, owner, n)
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(c)), dtype=np.uint64))) for c in (11, 17)]
        s1, s2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
        return {"id": part.column("id"), "th": part.column("th"), "n": np.diff(at), "s1": s1, "s2": s2, "sketch": sketches(h, at)}

    return map_slices(df, run, "id long, th long, n long, s1 long, s2 long, sketch binary")


def index(df: DataFrame, rule: Rule) -> DataFrame:
    """(entry, th, view): the index entries of every distinct text of a task; view * 2**16 + what it may leave out."""
    from pyspark.sql.functions import explode

    seen: set[int] = set()

    def run(part: pa.RecordBatch):
        if len(seen) > SEEN:
            seen.clear()
        names = part.column("th").to_pylist()
        fresh = []
        for i, t in enumerate(names):
            if t not in seen:
                seen.add(t)
                fresh.append(i)
        if not fresh:
            return None
        part = part.take(pa.array(fresh))
        h, _, owner = shingles_of(part.column("text"), rule.k)
        h, at = distinct_by_owner(h, owner, part.num_rows)
        out: dict[str, list] = {"th": [], "view": [], "entries": []}
        for i in range(part.num_rows):
            size = int(at[i + 1] - at[i])
            for view, spare, found in entries(h[at[i] : at[i + 1]], size, rule) if size else ():
                for name, value in zip(out, (names[fresh[i]], view << 16 | spare, found.view(np.int64))):
                    out[name].append(value)
        return out

    return map_slices(df, run, "th long, view long, entries array<long>").select(explode("entries").alias("entry"), "th", "view")


def _forest(shared_mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what the mask connects."""
    at = np.argwhere(shared_mask)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i, j in at.tolist():
        x, y = root(int(rows[i])), root(int(cols[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            a.append(int(rows[i]))
            b.append(int(cols[j]))
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _shared(tokens: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the sets ``left`` with the sets ``right``, through bounded dense slices."""
    distinct, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    more = counts[place] > 1
    place, owner = place[more], owner[more]
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4096
    total = int(place[-1]) + 1 if len(place) else 0
    for start in range(0, total, width):
        a, b = np.searchsorted(place, (start, start + width))
        has = np.zeros((n, min(width, total - start)), dtype=np.float32)
        has[owner[a:b], place[a:b] - start] = 1
        out += has[left] @ has[right].T
    return out


def _folded(data: np.ndarray, at: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """By sketch width in bytes the 64-bit words of the sketches of ``rows`` that are as wide or wider, folded to it."""
    size = at[rows + 1] - at[rows]
    out = {width: np.zeros((len(rows), width), dtype=np.uint8) for width in np.unique(size).tolist()}
    for one in out:
        some = np.flatnonzero(size == one)
        wide = data[at[rows[some]][:, None] + np.arange(one)]
        for width in out:
            if width <= one:
                out[width][some] = np.bitwise_xor.reduce(wide.reshape(len(some), -1, width), axis=1)
    return {width: words.view(np.uint64) for width, words in out.items()}


def _spread(rule: Rule, words: dict[int, np.ndarray], width: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the pairs that sizes (ascending) and sketches let be links: what has been reached is
    compared with what has not."""
    rest, queue = np.arange(len(n)), np.zeros(0, np.int64)
    a, b = [], []
    while len(rest):
        if not len(queue):
            queue, rest = rest[:1], rest[1:]
        same = width[queue] == width[queue[0]]
        same &= np.cumsum(same) <= max(1, (1 << 21) // max(len(rest) * int(width[queue[0]]), 1))
        now, queue = queue[same], queue[~same]
        sizes = n[now]
        low, high = np.searchsorted(n[rest], (-(-int(sizes.min()) * rule.num // rule.den), int(sizes.max()) * rule.den // rule.num + 1))
        some = rest[low:high]
        if not len(some):
            continue
        bits = words[int(min(width[now[0]], width[some[0]]))]
        differ = np.bitwise_count(bits[now][:, None] ^ bits[some][None]).sum(axis=2, dtype=np.int64)
        near = rule.possible(differ, sizes[:, None], n[some][None])
        hit = near.any(axis=0)
        if hit.any():
            a.append(now[near.argmax(axis=0)[hit]])
            b.append(some[hit])
            queue = np.concatenate((queue, some[hit]))
            rest = np.concatenate((rest[:low], some[~hit], rest[high:]))
    return a, b


def _near(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        hub, node, n = (np.asarray(table.column(c)) for c in ("hub", "node", "n"))
        kept = pa.concat_arrays(table.column("sketch").chunks).cast(pa.large_binary())
        at = np.frombuffer(kept.buffers()[1], np.int64)[kept.offset : kept.offset + len(kept) + 1]
        data = np.frombuffer(kept.buffers()[2], np.uint8)
        order = np.lexsort((n, hub))
        cuts = np.flatnonzero(np.diff(hub[order])) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(order, cuts):
            left, right = _spread(rule, _folded(data, at, rows), at[rows + 1] - at[rows], n[rows])
            a += [node[rows[x]] for x in left]
            b += [node[rows[x]] for x in right]
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _compare(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        nodes = np.asarray(table.column("node"))
        parts, sizes = [], []
        for piece in slices(iter(table.select(["text"]).to_batches())):  # shingles of a bounded stretch of text at a time
            h, _, owner = shingles_of(piece.column(0), rule.k)
            h, at = distinct_by_owner(h, owner, piece.num_rows)
            parts.append(h)
            sizes.append(np.diff(at))
        h, sizes = np.concatenate(parts), np.concatenate(sizes)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        left = np.flatnonzero(side != 1)
        right = np.flatnonzero(side != 0)
        shared = _shared(h, owner, len(nodes), left, right)
        mask = rule.linked(shared.astype(np.float64), sizes[left][:, None], sizes[right][None, :]) & (nodes[left][:, None] != nodes[right][None, :])
        a, b = _forest(mask, nodes[left], nodes[right])
        return pa.table({"a": a, "b": b})

    return run


def _hash(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def near_duplicates(df: DataFrame, k: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the least id reachable by links of similarity num / den or more."""
    sets, classes = _classes(df, k, num, den, key, text)
    per_set = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("least")).join(classes, ["s1", "s2"], "left")
    named = per_set.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    ids = per_set.join(named, "component", "left").select("s1", "s2", F.coalesce("component_id", "least").alias("component_id"))
    full = sets.where("n > 0").join(ids, ["s1", "s2"]).select("id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(sets.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def one_of_each(df: DataFrame, k: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without the near-duplicates of another: of each class the least (id, text hash) stays, of
    repeated rows one. Texts without a shingle all stay. Only (id, hash) pairs of rows that go are joined to the texts."""
    sets, classes = _classes(df, k, num, den, key, text)
    rows = sets.where("n > 0").groupBy("s1", "s2", F.coalesce("id", F.lit(-1)).alias("i"), "th").agg(F.count(F.lit(1)).alias("rows")).join(classes, ["s1", "s2"], "left")
    alone = lambda c: F.when(F.col("component").isNull(), F.col(c)).otherwise(0)
    rows = rows.select("i", "th", "rows", F.coalesce("component", F.lit(-1)).alias("g"), alone("s1").alias("g1"), alone("s2").alias("g2"))
    first = rows.groupBy("g", "g1", "g2").agg(F.min(F.struct("i", "th")).alias("one"))
    marked = rows.join(first, ["g", "g1", "g2"]).select("i", "th", "rows", ((F.col("i") == F.col("one.i")) & (F.col("th") == F.col("one.th"))).alias("stays"))
    marked = materialize(marked.where("not stays or rows > 1"), "marked")
    go = small(marked.where("not stays").select(F.col("i").alias("__gi"), F.col("th").alias("__gth")), "go")
    kept = df.withColumns({"__i": F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)), "__th": _hash(text)})
    on = (F.col("__i") == F.col("__gi")) & (F.col("__th") == F.col("__gth"))
    kept = kept.join(go, on, "left_anti")
    repeated = marked.where("stays").select(F.col("i").alias("__gi"), F.col("th").alias("__gth"))
    if repeated.limit(1).count():
        repeated = small(repeated, "repeated")
        kept = kept.join(repeated, on, "left_anti").union(kept.join(repeated, on, "left_semi").dropDuplicates(["__i", "__th"]))
    return kept.drop("__i", "__th")


def _possible(hot: DataFrame, nodes: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links enough to connect all sets that share an entry of ``hot`` and that their sketches let be linked.

    An entry's hub is its least set. All sets that share an entry with a hub are compared around it, so what meets
    under many entries is sent once; where they are many, they are dealt into blocks, each pair of them a task."""
    posts = materialize(hot.join(nodes, "th").select("entry", "node", "n"), "posts")
    hubs = posts.groupBy("entry").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other").select("entry", "hub")
    around = materialize(posts.join(hubs, "entry").select("hub", "node", "n").distinct(), "around")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CROWD, F.sum("n") / (2 * SKETCH_BYTES))).cast("int")
    groups = materialize(around.groupBy("hub").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements"), blocks.alias("blocks")), "hubs")
    alone = (F.col("sets") > FEW) | (F.col("blocks") > 1)
    parts = 1 + (groups.where(~alone).agg(F.sum("elements")).first()[0] or 0) // (2 * SKETCH_BYTES)
    at = F.when(alone, F.col("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(parts)))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != block) | (F.col("blocks") == 1))
    pairs = F.transform(others, lambda j: F.struct(F.least(block, j).alias("x"), F.greatest(block, j).alias("y")))
    dealt = around.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "hub").select("hub", "node", "n", at.alias("at"), F.explode(pairs).alias("t"))
    kept = members.select("node", "sketch")
    size = kept.agg(F.sum(F.length("sketch"))).first()[0] or 0
    dealt = dealt.select("hub", "node", "n", "at", "t.*").join(F.broadcast(kept) if size <= SKETCH_BYTES else kept, "node")
    return dealt.groupBy("at", "x", "y").applyInArrow(_near(rule), "a long, b long")


def _classes(df: DataFrame, k: int, num: int, den: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Sets by row, and (s1, s2, component) of the sets that are linked with another."""
    docs = keyed_text(df, key, text).withColumn("th", _hash())
    rule = Rule(k, num, den, docs.count())
    sets = materialize(shingle_sets(docs, rule), "sets")
    # Both uses below read one shuffle: the filter is spelled out and all columns are used, so that their plans are the same.
    posted = index(docs.select("id", "text", "th"), rule).where("entry is not null and th is not null and view is not null").repartition("entry")
    shared = posted.groupBy("entry").agg(F.count(F.lit(1)).alias("texts"), F.min("th").alias("low"), F.max("th").alias("high"), F.sum("view").alias("views"))
    shared = shared.where("low <> high and views >= 0").select("entry", "texts")
    costly = Window.partitionBy("th", "view").orderBy(F.col("texts").desc(), "entry")
    hot = posted.join(shared, "entry").withColumn("nth", F.row_number().over(costly)).where("nth > (view & 65535)").select("entry", "th")
    hot = materialize(hot, "entries")

    # One member for each distinct set under a shared entry: the least (id, text hash), numbered by a written table.
    full = sets.where("n > 0")
    members = full.join(hot.select("th").distinct(), "th").groupBy("s1", "s2").agg(F.min(F.struct(F.coalesce("id", F.lit(-1)).alias("i"), "th")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    step = math.log(den / num)
    members = members.select("s1", "s2", "n", "sketch", "one.i", "one.th", F.floor(F.log("n") / step).cast("int").alias("bin"), F.monotonically_increasing_id().alias("node"))
    members = materialize(members, "members")
    nodes = full.select("th", "s1", "s2").distinct().join(members.select("s1", "s2", "node", "n"), ["s1", "s2"]).select("th", "node", "n")
    families = with_roots(components(_possible(hot, nodes, members, rule), "families")).select("node", F.col("component").alias("family"))
    members = materialize(members.drop("sketch").join(families, "node"), "relatives")
    fits = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = members.groupBy("family", "bin").agg(fits.alias("blocks"), F.count(F.lit(1)).alias("sets"))
    alone = blocks.groupBy("family").agg(F.sum("sets").alias("all_sets")).where("all_sets > 1").select("family")
    blocks = blocks.join(alone, "family").drop("sets")
    above = blocks.select("family", (F.col("bin") - 1).alias("bin"), F.col("blocks").alias("above"))
    below = blocks.select("family", (F.col("bin") + 1).alias("bin"), F.col("blocks").alias("below"))
    dealt = materialize(
        members.join(blocks, ["family", "bin"]).join(above, ["family", "bin"], "left").join(below, ["family", "bin"], "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dealt"
    )
    few = dealt.count() <= BROADCAST_ROWS
    wanted = dealt.select("i", F.col("th").alias("wanted"), "node", "family", "bin", "block", "blocks", "above", "below")
    texts = docs.join(F.broadcast(wanted) if few else wanted, (F.coalesce("id", F.lit(-1)) == F.col("i")) & (F.col("th") == F.col("wanted"))).select("node", "family", "bin", "block", "blocks", "above", "below", "text").dropDuplicates(["node"])
    # A task compares blocks i <= j of one bin, or a block of a bin with a block of the next; side 2 is both sides.
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("bin").alias("at"), F.lit(0).alias("kind"), F.least("block", j).alias("x"), F.greatest("block", j).alias("y"), F.when(j == F.col("block"), 2).when(F.col("block") < j, 0).otherwise(1).alias("side")))
    none = F.array().cast("array<struct<at:int,kind:int,x:int,y:int,side:int>>")
    up = F.when(F.col("above").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: F.struct(F.col("bin").alias("at"), F.lit(1).alias("kind"), F.col("block").alias("x"), j.alias("y"), F.lit(0).alias("side"))))
    down = F.when(F.col("below").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda j: F.struct((F.col("bin") - 1).alias("at"), F.lit(1).alias("kind"), j.alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"))))
    tasks = texts.select("node", "family", "text", F.explode(F.concat(own, up, down)).alias("t")).select("family", "t.*", "node", "text")
    links = materialize(tasks.groupBy("family", "at", "kind", "x", "y").applyInArrow(_compare(rule), "a long, b long"), "links")

    joined = with_roots(components(links, "classes"))
    classes = members.select("s1", "s2", "node").join(joined, "node").select("s1", "s2", "component")
    return sets, classes
