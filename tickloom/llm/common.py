"""Shared helpers of the text operators: registry, Arrow batches of bounded text, hashing of words and shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SLICE_BYTES = 1 << 20  # text worked on at once inside a task; bounds memory, never cuts a text
MAX_ROWS = 1024


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """The needed columns under names of our own, so that other columns cannot clash."""
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(c) for c in more])


def crc_mod(column, k: int):
    """crc32 of a value as text, modulo k: the split into learning and held-out rows."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(k)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = MAX_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts total about ``limit`` bytes; a longer single text is a run of its own."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        start = total = 0
        for i in range(n):
            if i > start and (total + sizes[i] > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(sizes[i])
        yield batch.slice(start, n - start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, column: str = "text", limit: int = SLICE_BYTES, rows: int = MAX_ROWS) -> DataFrame:
    """Apply ``fn`` to bounded slices; it returns columns by name in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for part in slices(batches, column, limit, rows):
            out = fn(part)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=True) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_slices(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], column: str = "text", rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``df``, all columns as they are, where ``keep`` says so; nothing is shuffled."""

    def run(batches):
        for part in slices(batches, column, rows=rows):
            yield part.filter(pa.array(keep(part), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


# ---- hashing of words and shingles, over the bytes of a whole slice at once ----

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(factors)
    return have[:n]


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


SPAN_BYTES = 1 << 20


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans (words) of a byte array, worked on in stretches of about a megabyte: the working memory
    is a few times that, or a few times the longest single word."""
    out = np.empty(len(begin), dtype=np.uint64)
    first = 0
    while first < len(begin):
        last = max(int(np.searchsorted(end, begin[first] + SPAN_BYTES, side="right")), first + 1)
        low = begin[first]
        b, e = begin[first:last] - low, end[first:last] - low
        m = int(e[-1])
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data[low : low + m]] * _powers(_BASE, m), dtype=np.uint64)))
        out[first:last] = mix((running[e] - running[b]) * _powers(_INV, m + 1)[b] + (e - b).astype(np.uint64))
        first = last
    return out


def words_of(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words (ASCII letters lower-cased) of every text, and how many each text has."""
    if part.null_count:
        part = pa.compute.fill_null(part, "")
    texts = part.cast(pa.binary())
    n = len(texts)
    joined = np.frombuffer(b" ".join([*texts.to_pylist(), b""]), dtype=np.uint8)
    lengths = np.asarray(pa.compute.binary_length(texts), dtype=np.int64)
    starts_of_text = np.concatenate(([0], np.cumsum(lengths + 1)))
    if len(joined) == 0:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = ~_WHITE[joined]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = span_hashes(_LOWER[joined], begin, end)
    owner = np.searchsorted(starts_of_text, begin, side="right") - 1
    return hashes, np.bincount(owner, minlength=n).astype(np.int64)[:n]


def shingles_of(part: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, position, owner) of all k-word shingles, in order; a shorter text of at least one word is one shingle."""
    words, counts = words_of(part)
    n = len(counts)
    total = len(words)
    made = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), made)
    first = np.concatenate(([0], np.cumsum(made)))[:-1]
    position = np.arange(len(owner)) - first[owner]
    at = (np.concatenate(([0], np.cumsum(counts)))[:-1])[owner] + position
    out = np.full(len(owner), 0x51ED27, dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64))) if total else np.zeros(k, np.uint64)
    width = np.minimum(counts[owner], k)
    for j in range(k):
        step = mix(out * np.uint64(_BASE) + padded[at + j])
        out = np.where(j < width, step, out)
    return out, position, owner


def distinct_by_owner(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every owner, concatenated, and the offsets of the owners (n + 1)."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(n + 1))


BROADCAST_ROWS = 500_000


def small(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, written once; marked for broadcast only if its counted rows are few enough, else Spark shuffles it."""
    from tickloom.session import materialize

    kept = materialize(df, label)
    return F.broadcast(kept) if kept.count() <= limit else kept
