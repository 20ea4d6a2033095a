"""The feature-record store: normalising, appending by day, reading, reports."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schemas import RECORDS


# -- writing --------------------------------------------------------------------------------------


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a request id and a symbol, and the rest."""
    ok = F.coalesce((F.col("request_id") != "") & (F.col("symbol") != ""), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def normalize_request_id(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def _depth(t: T.DataType) -> int:
    return 1 + _depth(t.elementType) if isinstance(t, T.ArrayType) else 0


def feature_matrix(df: DataFrame, column: str) -> Column:
    """Any numeric array as array<array<float>>: flat becomes one row, two levels stay, deeper levels are
    flattened row by row, anything else is one empty row."""
    depth = _depth(df.schema[column].dataType)
    c = F.col(column)
    if depth == 0:
        return F.array(F.array().cast("array<float>"))
    if depth == 1:
        rows = F.array(c)
    else:
        rows = c
        for _ in range(depth - 2):
            rows = F.transform(rows, F.flatten)
    return F.coalesce(rows.cast("array<array<float>>"), F.array(F.array().cast("array<float>")))


def safe_json(df: DataFrame, column: str) -> Column:
    """Text stays text, complex values are encoded, NULL is the text ``null``."""
    t = df.schema[column].dataType
    complex_type = isinstance(t, (T.ArrayType, T.StructType, T.MapType))
    if complex_type:
        encoded = F.to_json(column)
    elif isinstance(t, T.StringType):
        encoded = F.col(column)
    else:
        encoded = F.col(column).cast("string")
    return F.coalesce(encoded, F.lit("null"))


def to_records(df: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows ready to append; ``dt`` is the UTC day of writing, not of the record."""
    written = created_at if created_at is not None else F.current_timestamp()
    out = df.select(
        normalize_request_id(F.col("request_id")).alias("request_id"),
        F.col("timestamp"),
        "symbol",
        "model_name",
        safe_json(df, "ohlcv_data").alias("ohlcv_data"),
        feature_matrix(df, "features").alias("features"),
        safe_json(df, "model_output").alias("model_output"),
        written.alias("created_at"),
    )
    return out.withColumn("dt", F.to_date("created_at"))


def append_records(df: DataFrame, path: str, metrics: Observation | None = None) -> None:
    """Append valid records by day in one transactional write, counting as it goes: no second pass."""
    ok = F.coalesce((F.col("request_id") != "") & (F.col("symbol") != ""), F.lit(False))
    counted = df.observe(
        metrics or Observation(), F.count(F.lit(1)).alias("queued"), F.count_if(ok).alias("written"), F.count_if(~ok).alias("dropped")
    )
    counted.filter(ok).write.mode("append").partitionBy("dt").parquet(path)


def write_metrics(observed: dict[str, int], errors: int = 0) -> dict[str, float]:
    queued = max(observed["queued"], 1)
    return {
        **observed,
        "errors": errors,
        "success_rate": observed["written"] / queued,
        "drop_rate": observed["dropped"] / queued,
    }


def write_report(df: DataFrame) -> DataFrame:
    """The same counts and rates as one row, by symbol-independent aggregate."""
    ok = F.coalesce((F.col("request_id") != "") & (F.col("symbol") != ""), F.lit(False))
    n = F.count(F.lit(1))
    base = F.greatest(n, F.lit(1)).cast("double")
    return df.agg(
        n.alias("queued"),
        F.count_if(ok).alias("written"),
        F.count_if(~ok).alias("dropped"),
        (F.count_if(ok) / base).alias("success_rate"),
        (F.count_if(~ok) / base).alias("drop_rate"),
    )


def write_aggregated(stats: DataFrame, path: str, window: int = 60) -> None:
    """Daily window statistics by symbol and day; the attributes travel as columns."""
    (
        stats.withColumn("dt", F.to_date("timestamp"))
        .withColumn("window_rows", F.lit(window))
        .withColumn("created_at", F.current_timestamp())
        .repartition("symbol", "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("symbol", "dt")
        .parquet(path)
    )


# -- reading --------------------------------------------------------------------------------------


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).parquet(path)


def date_of_file(path: Column) -> Column:
    """Day from a file name ``features_YYYYMMDD*``; any other name is an error."""
    day = F.regexp_extract(path, r"features_(\d{8})", 1)
    return F.when(day == "", F.raise_error(F.concat(F.lit("not a features_YYYYMMDD name: "), path)).cast("date")).otherwise(
        F.to_date(day, "yyyyMMdd")
    )


def select_records(df: DataFrame, symbol: str | None = None, model_name: str | None = None) -> DataFrame:
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    return df if model_name is None else df.filter(F.col("model_name") == model_name)


def features_of(df: DataFrame, request_ids: DataFrame) -> DataFrame:
    """Matrices of the wanted requests."""
    return df.join(request_ids.select("request_id").distinct(), "request_id", "left_semi").select("request_id", "features")


def parse_ohlcv(df: DataFrame, column: str = "ohlcv_data") -> DataFrame:
    """Records to bars. The payload is a JSON object, or a list of klines whose last entry counts. Bad JSON
    reads as all zeros, a missing field as 0; a field that is no number drops the row, as does a missing
    record time."""
    names = ["open", "high", "low", "close", "volume"]
    as_object = F.from_json(column, "map<string,string>")
    as_list = F.from_json(column, "array<array<string>>")
    is_list = F.ltrim(F.col(column)).startswith("[")
    last = F.try_element_at(as_list, F.lit(-1))
    parsed = df.filter(F.col("timestamp").isNotNull()).select(
        "symbol", "timestamp", F.when(~is_list, as_object).alias("_o"), F.when(is_list, last).alias("_l")
    )
    text = {
        n: F.coalesce(F.try_element_at("_o", F.lit(n)), F.get("_l", F.lit(i + 1)), F.lit("0")) for i, n in enumerate(names)
    }
    typed = parsed.select("symbol", "timestamp", *[c.try_cast("double").alias(n) for n, c in text.items()])
    return typed.dropna(subset=names)


# -- reports --------------------------------------------------------------------------------------


def store_stats(df: DataFrame) -> DataFrame:
    """Totals by model and by symbol and the overall range, one pass by grouping sets."""
    counted = df.groupingSets([["model_name"], ["symbol"], []], "model_name", "symbol").agg(
        F.grouping_id().alias("_id"),
        F.count(F.lit(1)).alias("records"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )
    kind = F.when(F.col("_id") == 1, "model").when(F.col("_id") == 2, "symbol").otherwise("total")
    name = F.coalesce("model_name", "symbol", F.lit(""))
    return counted.select(kind.alias("kind"), name.alias("name"), *counted.columns[3:])


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("symbol").alias("unique_symbols"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("records"))


def day_stats(df: DataFrame) -> DataFrame:
    """Per day: records, sorted symbols and models (sets of names, small by nature), true range."""
    return df.groupBy("dt").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.array_sort(F.collect_set("symbol")).alias("symbols"),
        F.array_sort(F.collect_set("model_name")).alias("models"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def day_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of every day of a stored table, from a file listing; no data is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    day = F.to_date(F.regexp_extract("path", r"/dt=(\d{4}-\d{2}-\d{2})/", 1))
    return files.groupBy(day.alias("dt")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def one_day(df: DataFrame, day: str) -> DataFrame:
    return day_stats(df.filter(F.col("dt") == F.to_date(F.lit(day), "yyyyMMdd")))


def partitions(df: DataFrame) -> DataFrame:
    return df.select("dt").distinct().orderBy(F.col("dt").desc())


def latest_of_days(df: DataFrame, n: int = 10, day: str | None = None, tie: str = "request_id") -> DataFrame:
    """Newest partition first, newest record first inside it."""
    if day is not None:
        df = df.filter(F.col("dt") == F.to_date(F.lit(day), "yyyyMMdd"))
    return df.orderBy(F.col("dt").desc(), F.col("timestamp").desc(), F.col(tie).desc()).limit(n)


def latest_inserted(df: DataFrame, n: int = 10, by: str = "inserted_at", tie: str = "request_id") -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n)


def by_request_id(stores: dict[str, DataFrame], request_id: str) -> DataFrame:
    """Every store is searched in full."""
    found = None
    for source, df in stores.items():
        hit = df.filter(F.col("request_id") == request_id).withColumn("source", F.lit(source))
        found = hit if found is None else found.unionByName(hit, allowMissingColumns=True)
    return found


def latest_merged(stores: dict[str, DataFrame], n: int = 10, tie: str = "request_id") -> DataFrame:
    """Latest n of each store, then the latest n of those, tagged with the store."""
    merged = None
    for source, df in stores.items():
        top = df.orderBy(F.col("timestamp").desc(), F.col(tie).desc()).limit(n).withColumn("source", F.lit(source))
        merged = top if merged is None else merged.unionByName(top, allowMissingColumns=True)
    return merged.orderBy(F.col("timestamp").desc(), F.col(tie).desc(), "source").limit(n)


def payload_summary(df: DataFrame) -> DataFrame:
    """Shape of the JSON payloads: bars in the snapshot, first and last of them, matrix size, first five."""
    bars = F.from_json("ohlcv_data", "array<array<string>>")
    is_list = F.ltrim(F.col("ohlcv_data")).startswith("[")
    first_row = F.try_element_at("features", F.lit(1))
    return df.select(
        "request_id",
        F.when(is_list, F.size(bars)).alias("n_bars"),
        F.when(is_list, F.to_json(F.try_element_at(bars, F.lit(1)))).alias("first_bar"),
        F.when(is_list, F.to_json(F.try_element_at(bars, F.lit(-1)))).alias("last_bar"),
        F.size("features").alias("n_rows"),
        F.coalesce(F.size(first_row), F.lit(0)).alias("n_columns"),
        F.slice(first_row, 1, 5).alias("first_five"),
    )


def expired_days(df: DataFrame, today: str, keep_days: int = 90) -> DataFrame:
    """Removed and kept days for a retention of ``keep_days``, strictly older only."""
    cutoff = F.date_sub(F.to_date(F.lit(today)), keep_days)
    days = df.select("symbol", "dt").distinct()
    return days.agg(
        F.count_if(F.col("dt") < cutoff).alias("removed"), F.count_if(F.col("dt") >= cutoff).alias("kept"), F.max(cutoff).alias("cutoff")
    )


def keep_recent(df: DataFrame, today: str, keep_days: int = 90) -> DataFrame:
    return df.filter(F.col("dt") >= F.date_sub(F.to_date(F.lit(today)), keep_days))


def remove_expired_days(spark: SparkSession, path: str, today: str, keep_days: int = 90) -> DataFrame:
    """Delete the day partitions of a stored table that are strictly older than ``keep_days``, whatever they are
    nested in; returns (removed, kept, cutoff), counted in partitions. Only directory names are read."""
    cutoff = (datetime.date.fromisoformat(today) - datetime.timedelta(days=keep_days)).isoformat()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    removed = kept = 0
    open_ = [hadoop(path)]
    while open_:
        for entry in fs.listStatus(open_.pop()):
            name = entry.getPath().getName()
            if name.startswith("dt=") and name[3:] < cutoff:
                fs.delete(entry.getPath(), True)
                removed += 1
            elif name.startswith("dt="):
                kept += 1
            elif entry.isDirectory() and not name.startswith("_"):
                open_.append(entry.getPath())
    return spark.sql(f"SELECT {removed}L AS removed, {kept}L AS kept, '{cutoff}' AS cutoff")
