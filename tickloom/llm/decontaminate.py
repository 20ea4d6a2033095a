"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Test items are short and documents long, so whole documents would make every similarity tiny. Items are put in
partitions by the number of their distinct k-word shingles (doubling upper bounds); for the partition with bound
s, every document is cut into windows of 2s shingles, one starting every s shingles, so that any run of s
shingles lies in one window. Within a partition the containment threshold t thus is a Jaccard threshold j of
about t / 4, and the partition gets so many MinHash values, of one row per band, that (1 - j) ** values < MISS.
Minima over windows are minima of two neighbouring blocks of s, and blocks of the next partition are pairs of
blocks of this one, so each hash passes over a document once, from the first partition that has items on.

An item and a document that share a minimum are a candidate, and their exact containment (distinct item
shingles found anywhere in the document / distinct item shingles) decides. Items are worked on in blocks of
bounded size, each sent to the tasks with its minima; a larger benchmark takes more passes, never more memory.

Rows: null or empty items and documents match nothing; an item of fewer than k words is one shingle, which only
a document with just these words has; null ids and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import distinct_by_owner, keyed_text, map_slices, mix, shingles_of, small

K = 5
THRESHOLD = 0.8
MISS = 1e-11  # chance that the search misses an item that stands in a document in one piece
ITEMS_AT_ONCE = 2_000  # items sent to every task at once, further bounded by
SHINGLES_AT_ONCE = 400_000
_SEEDS = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FILTER_BITS = 16


def hashes_for(bound: int, threshold: float) -> int:
    """MinHash values that a partition needs: its least Jaccard similarity of an item and its window decides."""
    least = 1.0
    for size in range(bound // 2 + 1, bound + 1):
        shared = max(1, math.ceil(threshold * size - 1e-9))
        least = min(least, shared / (2 * bound + size - shared))
    return min(len(_SEEDS), math.ceil(math.log(MISS) / math.log(1 - least))) if least < 1 else 1


class Items:
    """One block of test items: shingle sets, and minima by partition and hash."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: float = THRESHOLD):
        self.ids, self.sets = ids, sets
        sizes = np.array([len(s) for s in sets])
        part = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)  # bound 2 ** part
        self.first = int(part[sizes > 0].min()) if (sizes > 0).any() else 0
        self.minima = []  # by partition: per hash the sorted minima and the items they belong to
        for p in range(self.first, int(part.max(initial=0)) + 1):
            mine = np.flatnonzero((part == p) & (sizes > 0))
            rows = []
            for seed in _SEEDS[: hashes_for(2**p, threshold)] if len(mine) else ():
                values = np.array([(sets[i] * seed).min() for i in mine], dtype=np.uint64)
                order = np.argsort(values)
                rows.append((values[order], mine[order]))
            self.minima.append(rows)
        self.bits: dict = {}  # built where it is used: bitmaps of the minima's low bits

    def filter(self, p: int, k: int) -> np.ndarray:
        if (p, k) not in self.bits:
            bits = self.bits[p, k] = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[(self.minima[p][k][0] & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return self.bits[p, k]

    def candidates(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Pairs (document, item) that share a minimum in some window; a row each."""
        found = []
        counts = np.bincount(owner, minlength=n)
        base = 2**self.first
        blocks = -(-counts // base)
        first = np.concatenate(([0], np.cumsum(blocks)))
        position = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(counts)))[owner]
        block = first[owner] + position // base
        # The blocks of every partition are the same for all hashes: where they begin in the row before, whose they
        # are, and whether the next one is of the same document.
        heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        of = owner[heads]
        levels = []
        for p in range(len(self.minima)):
            if p:  # pairs of blocks of the partition below, counted from the start of each document
                edge = np.concatenate(([True], of[1:] != of[:-1]))
                place = np.arange(len(of)) - np.maximum.accumulate(np.where(edge, np.arange(len(of)), 0))
                heads = np.flatnonzero(place % 2 == 0)
                of = of[heads]
            levels.append((heads, of, np.flatnonzero(of[1:] == of[:-1])))
        low = np.uint64((1 << _FILTER_BITS) - 1)
        for k, seed in enumerate(_SEEDS[: max(map(len, self.minima), default=0)]):
            minima = hashes * seed
            for p, rows in enumerate(self.minima):
                heads, of, same = levels[p]
                minima = np.minimum.reduceat(minima, heads)
                if k >= len(rows):
                    continue
                window = minima.copy()
                window[same] = np.minimum(minima[same], minima[same + 1])
                values, items = rows[k]
                at = np.flatnonzero(self.filter(p, k)[(window & low).view(np.int64)])
                if len(at):
                    a, b = np.searchsorted(values, window[at], "left"), np.searchsorted(values, window[at], "right")
                    for i in np.flatnonzero(b > a):
                        found += [(int(of[at[i]]), int(j)) for j in items[a[i] : b[i]]]
        return np.unique(np.array(found, dtype=np.int64).reshape(-1, 2), axis=0)


def _item_blocks(items: DataFrame, key: str, text: str, k: int, threshold: float):
    """Blocks of items of bounded size, streamed from the workers one partition at a time."""

    def run(part: pa.RecordBatch):
        h, _, owner = shingles_of(part.column("text"), k)
        h, at = distinct_by_owner(h, owner, part.num_rows)
        return {"id": part.column("id"), "shingles": [h[at[i] : at[i + 1]].view(np.int64) for i in range(part.num_rows)]}

    ids, sets, total = [], [], 0
    for r in map_slices(keyed_text(items, key, text), run, "id long, shingles array<long>").where("size(shingles) > 0").toLocalIterator():
        if ids and (len(ids) >= ITEMS_AT_ONCE or total + len(r["shingles"]) > SHINGLES_AT_ONCE):
            yield Items(ids, sets, threshold)
            ids, sets, total = [], [], 0
        ids.append(r["id"])
        sets.append(np.array(r["shingles"], dtype=np.int64).view(np.uint64))
        total += len(r["shingles"])
    if ids:
        yield Items(ids, sets, threshold)


SCHEMA = "id long, item_id long, n_item long, n_common long, containment double"


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, n_item, n_common, containment) of every document row that holds ``threshold`` of an item's shingles."""
    rows = keyed_text(docs, key, text)
    out = None
    for block in _item_blocks(items, item_key, item_text, k, threshold):
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def run(part: pa.RecordBatch, sent=sent):
            h, _, owner = shingles_of(part.column("text"), k)
            if not len(h):
                return None
            ids, at = part.column("id").to_pylist(), np.searchsorted(owner, np.arange(part.num_rows + 1))
            it, cols = sent.value, ([], [], [], [], [])
            last, whole = -1, None
            for doc, item in it.candidates(h, owner, part.num_rows).tolist():
                if doc != last:
                    last, whole = doc, np.unique(h[at[doc] : at[doc + 1]])
                wanted = it.sets[item]
                place = np.minimum(np.searchsorted(whole, wanted), len(whole) - 1)
                shared = int((whole[place] == wanted).sum())
                if shared >= threshold * len(wanted) - 1e-9:
                    for c, v in zip(cols, (ids[doc], it.ids[item], len(wanted), shared, shared / len(wanted))):
                        c.append(v)
            return dict(zip(("id", "item_id", "n_item", "n_common", "containment"), cols)) if cols[0] else None

        found = map_slices(rows, run, SCHEMA)
        out = found if out is None else out.union(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no test item, with their columns. Which of several rows with one id goes is decided by id
    and text, so that a clean row never goes for another's sake; rows without an id are judged by text alone."""
    th = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    marked = docs.withColumn("__th", th)
    leaks = matches(marked, items, threshold, key="__th", text=text).select(F.col("id").alias("__leak")).distinct()
    leaks = small(leaks, "leaks")
    return marked.join(leaks, marked["__th"] == F.col("__leak"), "left_anti").drop("__th")
