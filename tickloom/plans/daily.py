"""The daily aggregation of feature records: parse, window statistics, completeness, write, report."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.layout import Chunking, tail_rows
from tickloom.operators.features import completeness, previous_window_stats
from tickloom.session import materialize
from tickloom.sources import records as rec
from tickloom.sources.commits import Folder, latest_state


def aggregate_records(records: DataFrame, window: int = 60, chunking: Chunking = Chunking()) -> DataFrame:
    """All symbols of a day at once; a bad payload costs its row, not its symbol."""
    return previous_window_stats(rec.parse_ohlcv(records), window, chunking)


NO_ROWS = "no usable payload among {} records"


def report(records: DataFrame, expected: int = 1440, warn_below: float = 0.9, parsed: DataFrame | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Per symbol and day: rows read, rows usable, completeness, whether anything could be processed and, if not, why.
    ``parsed`` names the usable rows where they are written already; ``symbols`` asks for these only, and one of them
    without any record is reported too, without a day."""
    if symbols is not None:
        records = records.where(F.col("symbol").isin(symbols))
        parsed = parsed if parsed is None else parsed.where(F.col("symbol").isin(symbols))
    usable = completeness(rec.parse_ohlcv(records) if parsed is None else parsed, expected, warn_below)
    seen = records.groupBy("symbol", F.to_date("timestamp").alias("dt")).agg(F.count(F.lit(1)).alias("records"))
    if symbols is not None:
        asked = records.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string").distinct()
        seen = asked.join(seen, "symbol", "left").fillna(0, ["records"])
    failed = F.col("rows").isNull()
    why = F.when(failed & (F.col("records") == 0), "no records").when(failed, F.format_string(NO_ROWS.replace("{}", "%d"), "records"))
    return seen.join(usable, ["symbol", "dt"], "left").select(
        "symbol",
        "dt",
        "records",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("completeness_pct", F.lit(0.0)).alias("completeness_pct"),
        F.coalesce("low", F.lit(True)).alias("low"),
        F.when(failed, "failed").otherwise("processed").alias("status"),
        why.alias("error"),
    )


def run_day(spark: SparkSession, store: str, out: str, day: str, window: int = 60, chunking: Chunking = Chunking()) -> DataFrame:
    """One day of the store (``YYYY-MM-DD``) to the aggregated table; returns the report. Running it again
    replaces that day's partitions."""
    records = rec.read_records(spark, store).filter(F.col("dt") == F.to_date(F.lit(day)))
    parsed = materialize(rec.parse_ohlcv(records), "parsed")  # payloads are parsed once
    rec.write_aggregated(previous_window_stats(parsed, window, chunking), out, window)
    return report(records, parsed=parsed)


# -- a day in parts -------------------------------------------------------------------------------


def run_part(spark: SparkSession, records: DataFrame, out: str, writer: str, batch: int, window: int = 60, chunking: Chunking = Chunking()) -> DataFrame | None:
    """Aggregate records that came since the last part, which are all this run reads: statistics look back into the
    last ``window`` rows of each symbol, carried from part to part beside the table, and counts add up. A part that comes
    again changes nothing (None). Rows not newer than what a symbol already has are late: they are
    counted, not written; ``run_day`` makes the day anew. Returns rows and late rows per symbol and day so far."""
    folder = Folder(spark, out)
    state = {"parts": [], "carry": None, "counts": None} | latest_state(folder)
    if state["writers"].get(writer, -1) >= batch:
        return None
    data, mark = os.path.join(out, "data"), uuid.uuid4().hex
    new = materialize(rec.parse_ohlcv(records), "part")
    carry = new.limit(0) if state["carry"] is None else spark.read.schema(new.schema).parquet(os.path.join(data, state["carry"]))
    seen = carry.groupBy("symbol").agg(F.max("timestamp").alias("_newest"))
    marked = new.join(seen, "symbol", "left").withColumn("_late", F.coalesce(F.col("timestamp") <= F.col("_newest"), F.lit(False))).drop("_newest")
    on_time = materialize(marked.where("not _late").drop("_late"), "on-time")
    both = carry.withColumn("_carried", F.lit(True)).unionByName(on_time.withColumn("_carried", F.lit(False)))
    rows = previous_window_stats(both, window, chunking).where("not _carried").drop("_carried")
    rec.write_aggregated(rows, os.path.join(data, f"part-{mark}"), window)
    tail_rows(both.drop("_carried"), window, chunking).write.parquet(os.path.join(data, f"carry-{mark}"))
    counts = marked.groupBy("symbol", F.to_date("timestamp").alias("dt")).agg(F.count_if(~F.col("_late")).alias("rows"), F.count_if("_late").alias("late"))
    if state["counts"] is not None:
        counts = counts.unionByName(spark.read.schema(counts.schema).parquet(os.path.join(data, state["counts"]))).groupBy("symbol", "dt").agg(F.sum("rows").alias("rows"), F.sum("late").alias("late"))
    counts.write.parquet(os.path.join(data, f"counts-{mark}"))
    note = {"sequence": state["sequence"] + 1, "writers": state["writers"] | {writer: batch}, "parts": [*state["parts"], f"part-{mark}"], "carry": f"carry-{mark}", "counts": f"counts-{mark}"}
    folder.create(f"{note['sequence']:020d}.json", note)
    return spark.read.schema(counts.schema).parquet(os.path.join(data, f"counts-{mark}"))


def read_parts(spark: SparkSession, out: str) -> DataFrame:
    """The aggregated rows of all parts that are noted."""
    found = None
    for name in latest_state(Folder(spark, out)).get("parts", []):
        part = spark.read.parquet(os.path.join(out, "data", name))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError(f"no part is stored in {out}")
    return found
