"""Reading little of a stored table: newest days first, one id by Bloom filters, counts from file footers."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import materialize, scratch_path

DAY = "dt"


def write_lookup_store(df: DataFrame, path: str, key: str = "request_id", ndv: int = 1_000_000, block_bytes: int = 16 << 20) -> None:
    """Append by day, each file sorted by ``key`` and with a Bloom filter of it in every row group (about ``ndv`` distinct
    ids a group), so that a lookup leaves out the row groups that do not hold its id."""
    laid = df.repartition(DAY, F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions(DAY, key)
    (
        laid.write.mode("append").partitionBy(DAY)
        .option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(ndv))
        .option("parquet.block.size", str(block_bytes))
        .parquet(path)
    )


def days_of(spark: SparkSession, path: str) -> list[str]:
    """The stored days, newest first, from directory names alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    days, open_ = set(), [at(path)]
    while open_:
        for entry in fs.listStatus(open_.pop()):
            name = entry.getPath().getName()
            if name.startswith(f"{DAY}="):
                days.add(name.split("=", 1)[1])
            elif entry.isDirectory() and not name.startswith("_"):
                open_.append(entry.getPath())
    return sorted(days, reverse=True)


def footer_counts(spark: SparkSession, path: str, by: tuple[str, ...] = (DAY,), low: tuple[str, ...] = (), high: tuple[str, ...] = ()) -> DataFrame:
    """Rows, and least and greatest values of whole-number or date columns, per partition: an aggregate that
    the Parquet source answers from file footers; no column is read."""
    session = spark.newSession()  # the settings below are for this read alone
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(f"min_{c}") for c in low], *[F.max(c).alias(f"max_{c}") for c in high]]
    counted = session.read.parquet(path).groupBy(*by).agg(*aggs)
    out = scratch_path(spark, "footers")
    counted.write.parquet(out)
    return spark.read.schema(counted.schema).parquet(out)


def _midnight_after(day: str) -> datetime.datetime:
    return datetime.datetime.combine(datetime.date.fromisoformat(day) + datetime.timedelta(days=1), datetime.time())


def newest_first(spark: SparkSession, path: str, n: int, by: str = "timestamp", tie: str = "request_id", day_first: bool = False, df: DataFrame | None = None) -> tuple[DataFrame, list[list[str]]]:
    """The ``n`` rows with the greatest ``by`` of a store partitioned by day, and which days each step read.

    Days are read from the newest on, one, then two, then four at a time, each step with a filter on its days, until no
    day left can hold a better row. A row's ``by`` is before the end of its day (a record is written after it was
    stamped); a whole-number ``by`` needs no such rule, for its greatest value of each day stands in the footers.
    ``day_first`` ranks by day and then by ``by``. ``df`` is the store as a frame with further columns or filters.
    """
    stored = spark.read.parquet(path) if df is None else df
    whole = dict(stored.dtypes)[by] in ("bigint", "int", "smallint", "tinyint")
    bounds: dict[str, object] = {d: _midnight_after(d) for d in days_of(spark, path)}
    if whole and not day_first:
        bounds = {str(r[DAY]): r[f"max_{by}"] for r in footer_counts(spark, path, high=(by,)).collect() if r[f"max_{by}"] is not None}
    left = sorted(bounds, key=(lambda d: d) if day_first or not whole else (lambda d: (bounds[d], d)), reverse=True)
    rank: list[Column] = [F.col(c).desc_nulls_last() for c in ([DAY] if day_first else [])] + [F.col(by).desc_nulls_last(), F.col(tie).desc_nulls_last()]
    best, steps, width = None, [], 1
    while left:
        step, left, width = left[:width], left[width:], width * 2
        steps.append(step)
        top = stored.where(F.col(DAY).isin([datetime.date.fromisoformat(d) for d in step])).orderBy(*rank).limit(n)
        best = materialize((top if best is None else best.unionByName(top)).orderBy(*rank).limit(n), "newest")
        have = best.agg(F.count(F.lit(1)).alias("k"), F.count(by).alias("known"), F.min(by).alias("worst")).first()
        if left and have["k"] >= n and (day_first or (have["known"] >= n and _beyond(have["worst"], bounds[left[0]], whole))):
            break
    return (stored.limit(0) if best is None else best.orderBy(*rank)), steps


def _beyond(worst, bound, whole: bool) -> bool:
    """Whether nothing below ``bound`` (a whole number itself included) can come before or tie with ``worst``."""
    return worst > bound if whole else worst >= bound


def rows_read(df: DataFrame) -> int:
    """Run ``df`` and say how many rows its file scans handed on, from Spark's own scan metrics."""
    df.collect()
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            open_.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            open_.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            metric = node.metrics().get("numOutputRows")
            total += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return total
