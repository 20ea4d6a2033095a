"""Streaming ingest of bars: parse, validate, upsert by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.sources.bars import parse_klines
from tickloom.sources.commits import commit_bars, stream_writer


def clean_stream(bars: DataFrame) -> DataFrame:
    """Valid bars. Repeats are left to the upsert, which knows all that is stored, however late they come."""
    return bars.filter(F.coalesce((F.col("symbol") != "") & F.col("timestamp").isNotNull(), F.lit(False)))


def parse_stream(raw: DataFrame, column: str = "klines") -> tuple[DataFrame, DataFrame]:
    """Lenient parse of a kline stream: good bars and the quarantine."""
    parsed = parse_klines(raw, column, strict=False)
    return parsed.filter(~F.col("_bad")).drop("_bad"), parsed.filter(F.col("_bad"))


def upsert_stream(bars: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "1 minute", order: tuple[str, ...] = ()) -> StreamingQuery:
    """Upsert every micro-batch into the day-partitioned table: a bar is kept once, the last write wins, and bars of
    any age get in. Versions come from the table's commit log, not from the stream: a stream with a new checkpoint goes
    on after all that is stored, and a batch that comes again after a failure changes nothing. ``order`` names the
    columns (a source's offset, an arrival time) that order repeated bars inside a batch."""

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commit_bars(spark, path, batch, stream_writer(spark, checkpoint), number, order)

    writer = bars.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
