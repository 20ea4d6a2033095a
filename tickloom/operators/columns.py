"""Whole-column operators of the rolling library: rank, scale, norm, linear decay.

Ranks over a whole symbol do not sort it in one task. Equal values are first reduced to one counted row;
those are sorted by range over a number of tasks that follows from how many there are, and a prefix over the
tasks' totals completes the exact position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import CHUNK, HALO, Chunking, chunked, unchunked
from tickloom.functions.numeric import div
from tickloom.session import materialize

RANGE = "_range"
ROWS_A_RANGE = 250_000


def positions(counted: DataFrame, keys: list[str], value: str, weights: list[str], rows: int = ROWS_A_RANGE, at_most: int | None = None) -> DataFrame:
    """``counted`` (one row per key and value) plus ``<w>_before``: the sum of each weight over smaller
    values of the key. Sorted by range over as many tasks as ``rows`` counted rows each ask for. A caller who knows that there are ``at_most`` so many saves the count."""
    few = at_most is not None and at_most <= rows
    kept = counted if few else materialize(counted, "counted")
    tasks = 1 if few else -(-kept.count() // rows)
    inside = Window.partitionBy(*keys, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    if tasks <= 1:
        one = kept.withColumn(RANGE, F.lit(0))
        return one.select(*counted.columns, *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"{w}_before") for w in weights])
    laid = materialize(kept.repartitionByRange(tasks, *keys, value).withColumn(RANGE, F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    tops = laid.groupBy(*keys, RANGE).agg(*[F.sum(w).alias(f"_{w}_top") for w in weights])
    mine = [f"_{k}_of" for k in (*keys, RANGE)]
    tops = tops.select(*[F.col(k).alias(m) for k, m in zip((*keys, RANGE), mine)], *[F.coalesce(F.sum(f"_{w}_top").over(earlier), F.lit(0)).alias(f"_{w}_base") for w in weights])
    out = laid.join(tops, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip((*keys, RANGE), mine)])  # keys may be null
    before = [(F.col(f"_{w}_base") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_before") for w in weights]
    return out.select(*counted.columns, *before)


def pct_rank(df: DataFrame, value: str, out: str = "rank", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Average rank over the key's whole column as a share of its non-null count."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    placed = positions(counted, list(keys), value, ["n"])
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    ranks = placed.join(total, list(keys)).select(
        *keys, value, ((F.col("n_before") + (F.col("n") + 1) / 2.0) / F.col("_total")).alias(out)
    )
    return df.join(ranks, [*keys, value], "left").select(*df.columns, out)


def _with_totals(df: DataFrame, keys: tuple[str, ...], **aggs: Column) -> DataFrame:
    """One small aggregate per key joined back, instead of a frame over the whole key."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), list(keys), "left")


def scale(df: DataFrame, value: str, k: float = 1.0, out: str = "scaled", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """So that the absolute values of a key sum to ``k``."""
    t = _with_totals(df, keys, _total=F.sum(F.abs(value)))
    return t.withColumn(out, div(F.col(value) * k, F.col("_total"))).select(*df.columns, out)


def norm(df: DataFrame, value: str, out: str = "normed", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Min-max over the key's whole column."""
    t = _with_totals(df, keys, _low=F.min(value), _high=F.max(value))
    return t.withColumn(out, div(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))).select(*df.columns, out)


def fill_holes(df: DataFrame, value: str, chunking: Chunking | None = Chunking()) -> DataFrame:
    """Holes take the last value before them, at the head the first after, else 0.

    A donor may lie any distance away, in another chunk: each chunk's last known value is carried into the
    next ones, and the head takes the symbol's first known value, each by one row per chunk.
    """
    laid = chunked(df, 0, chunking) if chunking else unchunked(df)
    w = Window.partitionBy("symbol", CHUNK).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumn("_known", F.last(value, ignorenulls=True).over(w))
    known_at = F.when(F.col(value).isNotNull(), F.col("timestamp"))
    ends = laid.groupBy("symbol", CHUNK).agg(F.max_by(value, known_at).alias("_last"), F.min_by(value, known_at).alias("_first"))
    order = Window.partitionBy("symbol").orderBy(CHUNK)
    carry = ends.select(
        "symbol",
        CHUNK,
        F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_head"),
    )
    filled = F.coalesce("_known", "_left", "_head", F.lit(0.0)).alias(value)
    return laid.join(carry, ["symbol", CHUNK]).select(*[filled if c == value else F.col(c) for c in df.columns])


def decay_linear(df: DataFrame, value: str, period: int = 10, out: str = "decayed", chunking: Chunking | None = Chunking()) -> DataFrame:
    """Mean with weights 1..period, newest heaviest, holes filled first; rows before ``period - 1`` keep
    the value itself."""
    filled = fill_holes(df, value, chunking)
    laid = chunked(filled, period, chunking, counts_from=df) if chunking else unchunked(filled)
    w = Window.partitionBy("symbol", CHUNK).orderBy("timestamp")
    divisor = period * (period + 1) / 2.0
    total = F.col(value) * (period / divisor)
    for back in range(1, period):
        total = total + F.lag(value, back).over(w) * ((period - back) / divisor)
    early = (F.row_number().over(w) < period) & (F.col(CHUNK) == 0)
    return laid.withColumn(out, F.when(early, F.col(value)).otherwise(total)).filter(~F.col(HALO)).select(*df.columns, out)
