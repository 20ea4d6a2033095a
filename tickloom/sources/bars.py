"""Bar sources: parsing klines, stored scans, upserts, gaps, retention and cache reports."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import CHUNK, HALO, Chunking, chunked, tail_rows
from tickloom.schemas import BARS, KLINE_FIELDS
from tickloom.session import materialize
from tickloom.sources.lookups import footer_counts
from tickloom.sources.records import remove_expired_days

# Minutes per interval name.
INTERVAL_MINUTES = {
    "1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480,
    "12h": 720, "1d": 1440, "3d": 4320, "1w": 10080, "1M": 43200,
}
MAX_CACHE_MINUTES = 50500


def interval_minutes(name: Column) -> Column:
    """Minutes of an interval name; unknown names count as one minute."""
    pairs = [v for k, m in INTERVAL_MINUTES.items() for v in (F.lit(k), F.lit(m))]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit(1))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BARS).parquet(path)


def time_range(df: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """Both ends inclusive, floored to the minute, UTC; empty when start lies after end."""
    low, high = (F.date_trunc("minute", F.lit(v).cast("timestamp")) for v in (start, end))
    return df.filter((F.col(ts) >= low) & (F.col(ts) <= high))


def parse_klines(df: DataFrame, column: str = "klines", strict: bool = True) -> DataFrame:
    """JSON lists of twelve-field klines to typed bars; duplicates stay.

    ``strict`` raises on a value of the wrong type. Otherwise such rows are kept with the offending
    fields NULL and ``_bad`` set, for the caller to quarantine.
    """
    keep = [c for c in df.columns if c != column]
    one = df.select(*keep, F.explode(F.from_json(column, "array<array<string>>")).alias("k"))
    raw = {name: F.get("k", F.lit(i)) for i, name in enumerate(KLINE_FIELDS)}

    def typed(name: str, kind: str) -> Column:
        return raw[name].cast(kind) if strict else raw[name].try_cast(kind)

    out = {"timestamp": F.timestamp_millis(typed("timestamp", "bigint"))}
    for field in BARS.fields:
        if field.name not in ("symbol", "timestamp"):
            out[field.name] = typed(field.name, field.dataType.simpleString())
    result = one.select(*keep, *[c.alias(n) for n, c in out.items()])
    if not strict:
        result = result.withColumn("_bad", F.greatest(*[F.col(n).isNull() for n in out]))
    return result


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """Union with the newest ``version`` of every key winning; a plain aggregate, so it combines map-side."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), version).alias("_row")
    return both.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*both.columns)


def write_days(df: DataFrame, path: str, ts: str = "timestamp", keys: tuple[str, ...] = ("symbol", "interval")) -> None:
    """Replace exactly the partitions present in ``df``. A day of one key is spread over tasks by hash."""
    (
        df.withColumn("dt", F.to_date(ts))
        .repartition(*keys, F.to_date(ts), F.pmod(F.xxhash64(ts), F.lit(8)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys, "dt")
        .parquet(path)
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored_days(spark: SparkSession, path: str, days: list) -> DataFrame:
    """The rows of these days; the days are literals, so only their partitions are listed and read."""
    return spark.read.parquet(path).filter(F.col("dt").isin(days))


def upsert_days(spark: SparkSession, path: str, incoming: DataFrame, version: str = "ingest_ts") -> None:
    """Upsert into a day-partitioned table. Only the days that ``incoming`` touches are read back, and of them
    only the touched (symbol, interval) are rewritten; a path without a table starts one."""
    new = materialize(incoming, "incoming")
    touched = new.select("symbol", "interval", F.to_date("timestamp").alias("dt")).distinct()
    days = [r["dt"] for r in touched.select("dt").distinct().collect()]  # one date per day in the batch
    old = new.limit(0)
    if days and path_exists(spark, path):
        old = stored_days(spark, path, days).join(touched, ["symbol", "interval", "dt"], "left_semi").select(*new.columns)
    merged = upsert_latest(old, new, ("symbol", "interval", "timestamp"), version)
    write_days(materialize(merged, "upsert"), path)


def missing_ranges(bars: DataFrame, start: str, end: str, minutes: int = 1, chunking: Chunking = Chunking()) -> DataFrame:
    """Missing spans of every symbol in [start, end]: head, inner gaps, tail. A symbol that exists in
    ``bars`` but has no row in the range misses all of it."""
    step = F.expr(f"interval {int(minutes)} minutes")
    low, high = (F.date_trunc("minute", F.lit(v).cast("timestamp")) for v in (start, end))
    inside = time_range(bars, start, end).select("symbol", "timestamp")
    laid = chunked(inside, 1, chunking)
    before = F.lag("timestamp").over(Window.partitionBy("symbol", CHUNK).orderBy("timestamp"))
    gaps = (
        laid.withColumn("_before", before)
        .filter(~F.col(HALO) & (F.col("timestamp") > F.col("_before") + step))
        .select("symbol", (F.col("_before") + step).alias("gap_start"), (F.col("timestamp") - step).alias("gap_end"))
    )
    known = bars.select("symbol").distinct()
    ends = inside.groupBy("symbol").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    ends = known.join(ends, "symbol", "left")
    none = F.col("first").isNull()
    spans = F.array(
        F.struct((none | (low < F.col("first"))).alias("on"), low.alias("gap_start"), F.coalesce(F.col("first") - step, high).alias("gap_end")),
        F.struct((~none & (high > F.col("last"))).alias("on"), (F.col("last") + step).alias("gap_start"), high.alias("gap_end")),
    )
    outer = ends.select("symbol", F.inline(spans)).filter("on").drop("on")
    return outer.unionByName(gaps)


def drop_expired(bars: DataFrame, now: str, minutes: int = MAX_CACHE_MINUTES) -> DataFrame:
    """Keep the last ``minutes`` minutes before ``now``."""
    return bars.filter(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(minutes)} minutes"))


def clear(bars: DataFrame) -> DataFrame:
    return bars.limit(0)


def cache_stats(bars: DataFrame) -> DataFrame:
    """Rows, range and span in days of every symbol."""
    first, last = F.min("timestamp"), F.max("timestamp")
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_records"),
        first.alias("earliest_time"),
        last.alias("latest_time"),
        F.round((last.cast("double") - first.cast("double")) / 86400.0, 2).alias("time_span_days"),
    )


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a path, from a file listing: one row a file, no data is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    return listed.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def stored_stats(spark: SparkSession, path: str) -> DataFrame:
    """``cache_stats`` of a stored table of days: rows from the file footers, times from the first and the last day of
    each symbol only."""
    counts = footer_counts(spark, path, ("symbol", "dt"))
    ends = counts.groupBy("symbol").agg(F.sum("rows").alias("total_records"), F.min("dt").alias("low"), F.max("dt").alias("high"))
    edge = ends.select("symbol", F.explode(F.array_distinct(F.array("low", "high"))).alias("dt"))
    days = [r["dt"] for r in edge.select("dt").distinct().collect()]  # at most two a symbol; they prune the scan
    times = spark.read.parquet(path).where(F.col("dt").isin(days)).join(edge, ["symbol", "dt"], "left_semi") if days else spark.read.parquet(path).limit(0)
    first, last = F.min("timestamp"), F.max("timestamp")
    span = times.groupBy("symbol").agg(first.alias("earliest_time"), last.alias("latest_time"), F.round((last.cast("double") - first.cast("double")) / 86400.0, 2).alias("time_span_days"))
    return ends.select("symbol", "total_records").join(span, "symbol")


def remove_expired(spark: SparkSession, path: str, now: str, minutes: int = MAX_CACHE_MINUTES) -> tuple[int, int]:
    """Remove the stored bars that are older than ``minutes`` before ``now``: whole days by their folders, the day that the
    limit cuts by rewriting it. Returns how many day folders went and how many rows of the cut day."""
    limit = datetime.datetime.fromisoformat(now) - datetime.timedelta(minutes=minutes)
    cut = limit.date().isoformat()
    gone = remove_expired_days(spark, path, cut, 0).first()["removed"]
    old = F.col("timestamp") < F.lit(limit.isoformat(" ")).cast("timestamp")
    cut_day = stored_days(spark, path, [limit.date()])
    late = cut_day.where(old).count()
    if late:
        keep = materialize(cut_day.where(~old).drop("dt"), "kept")
        touched = materialize(cut_day.select("symbol", "interval", "dt").distinct(), "touched")
        empty = touched.join(keep.select("symbol", "interval").distinct(), ["symbol", "interval"], "left_anti")
        if not keep.isEmpty():
            write_days(keep, path)
        for r in empty.collect():  # one row per symbol and interval of the cut day
            remove_folder(spark, f"{path}/symbol={r['symbol']}/interval={r['interval']}/dt={cut}")
    return gone, late


def clear_store(spark: SparkSession, path: str, symbol: str | None = None) -> None:
    """Remove everything stored, or everything of one symbol."""
    remove_folder(spark, path if symbol is None else f"{path}/symbol={symbol}")


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def freshness(bars: DataFrame, expected: str, close_time: str = "close_time") -> DataFrame:
    """Whether the newest bar of each symbol closes at or after the expected minute."""
    last = F.max_by(close_time, "timestamp")
    want = F.date_trunc("minute", F.lit(expected).cast("timestamp"))
    return bars.groupBy("symbol").agg(last.alias("last_close_time"), (last >= want).alias("fresh"))


def latest_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "timestamp").alias("cur_price"))


def with_current_price(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions with the newest close of their symbol; one row per symbol on the right. A prediction whose
    symbol has no bar stays, without a price."""
    return predictions.drop("cur_price").join(latest_close(bars), "symbol", "left")


def wanted_symbols(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted.select("symbol").distinct(), "symbol", "left_semi")


def missing_symbols(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("symbol").distinct().join(df.select("symbol").distinct(), "symbol", "left_anti")


def snapshot(bars: DataFrame, n: int = 100, chunking: Chunking = Chunking()) -> DataFrame:
    """The last ``n`` bars of every symbol as one array, oldest first."""
    tail = tail_rows(bars, n, chunking)
    rest = [c for c in bars.columns if c != "symbol"]
    ordered = ["timestamp", *[c for c in rest if c != "timestamp"]]
    return tail.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("ohlcv"))
