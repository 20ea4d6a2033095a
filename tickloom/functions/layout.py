"""Cut long series into row-balanced chunks with a halo, so that one big symbol is many tasks.

Windows here count *rows*. Partitioning them by symbol alone would put a symbol with a third of all
rows into one task. Instead:

1. rows are counted per (symbol, micro), a micro being a fixed span of time - one small aggregate with
   map-side combine;
2. a two-level prefix over those counts gives every micro its first row number, from which its chunk
   follows (``first_row // chunk_rows``) and the later chunks that need it as context (``halo`` rows);
3. the rows take their chunk by an equi-join on (symbol, micro). No side is hinted: the count table is
   broadcast by Spark only when its measured size allows, else both sides are hashed.

Everything downstream then partitions on (symbol, chunk): one exchange, one sort, any number of frames.
Rows sent along as context carry ``_halo`` and are dropped at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
HALO = "_halo"
MICRO = "_micro"
MACRO_SPAN = 4096


@dataclass(frozen=True)
class Chunking:
    """``rows``: target rows per chunk. ``micro_seconds``: time span counted as one unit; at one bar a
    minute the default holds 1000 rows. Keep it well below ``rows`` times the bar interval."""

    rows: int = 100_000
    micro_seconds: int = 60_000
    order: str = "timestamp"
    keys: tuple[str, ...] = ("symbol",)


def micro_of(order: str, seconds: int) -> Column:
    return F.floor(F.col(order).cast("double") / F.lit(float(seconds))).cast("long")


def prefix_by_micro(counts: DataFrame, keys: tuple[str, ...], value: str, out: str) -> DataFrame:
    """Exclusive prefix of ``value`` per key in micro order, in two levels so that even the count table
    of one very long key is not a single sorted task."""
    macro = F.floor(F.col(MICRO) / F.lit(MACRO_SPAN)).cast("long")
    tagged = counts.withColumn("_macro", macro)
    tops = tagged.groupBy(*keys, "_macro").agg(F.sum(value).alias("_top"))
    over_tops = Window.partitionBy(*keys).orderBy("_macro").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_macro", F.coalesce(F.sum("_top").over(over_tops), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_macro").orderBy(MICRO).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(tops, [*keys, "_macro"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_macro", "_base")
    )


def micro_counts(df: DataFrame, cfg: Chunking) -> DataFrame:
    counts = (
        df.select(*cfg.keys, micro_of(cfg.order, cfg.micro_seconds).alias(MICRO))
        .groupBy(*cfg.keys, MICRO)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return prefix_by_micro(counts, cfg.keys, "_n", "_first")


def chunked(df: DataFrame, halo: int, cfg: Chunking, counts_from: DataFrame | None = None) -> DataFrame:
    """``df`` plus ``_chunk`` and ``_halo``; every chunk holds at least ``halo`` earlier rows of its symbol
    as context (all of them when fewer exist). ``counts_from`` names a cheaper frame with the same rows,
    so that counting does not repeat the work that led to ``df``."""
    rows = F.lit(cfg.rows)
    own = F.floor(F.col("_first") / rows).cast("long")
    last = F.floor((F.col("_first") + F.col("_n") + F.lit(halo - 1)) / rows).cast("long")
    last = last if halo else own
    targets = micro_counts(df if counts_from is None else counts_from, cfg).select(
        *cfg.keys,
        MICRO,
        own.alias("_own"),
        F.explode(F.sequence(own, F.greatest(own, last))).alias(CHUNK),
    )
    targets = targets.select(*cfg.keys, MICRO, CHUNK, (F.col(CHUNK) != F.col("_own")).alias(HALO))
    rows_in = df.withColumn(MICRO, micro_of(cfg.order, cfg.micro_seconds))
    return rows_in.join(targets, [*cfg.keys, MICRO]).drop(MICRO)


def unchunked(df: DataFrame) -> DataFrame:
    """Same columns for series whose length is bounded (a tail of N rows per symbol)."""
    return df.select("*", F.lit(0).cast("long").alias(CHUNK), F.lit(False).alias(HALO))


def tail_rows(df: DataFrame, n: int, cfg: Chunking, tie: tuple[str, ...] = ()) -> DataFrame:
    """Last ``n`` rows of every symbol. Micros that lie wholly before the tail are dropped by the count
    table first, so the final ranking sees at most ``n`` rows plus one micro per symbol."""
    counts = micro_counts(df, cfg)
    total = counts.groupBy(*cfg.keys).agg(F.max(F.col("_first") + F.col("_n")).alias("_total"))
    wanted = (
        counts.join(total, list(cfg.keys))
        .filter(F.col("_first") + F.col("_n") > F.col("_total") - F.lit(n))
        .select(*cfg.keys, MICRO)
    )
    newest = Window.partitionBy(*cfg.keys).orderBy(F.col(cfg.order).desc(), *[F.col(t).desc() for t in tie])
    return (
        df.withColumn(MICRO, micro_of(cfg.order, cfg.micro_seconds))
        .join(wanted, [*cfg.keys, MICRO])
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
        .drop(MICRO, "_rn")
    )


def carry_in(summary: DataFrame, keys: tuple[str, ...], total: Column, out: str) -> DataFrame:
    """Exclusive running total over the chunks of each key (one row per chunk)."""
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, CHUNK, F.coalesce(F.sum(total).over(before), F.lit(0.0)).alias(out))
