"""Relational views that turn the sample tables into bars, orders, fills, predictions and records.

The registered queries run on these. Each is plain Spark over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; its zone-less timestamps are UTC instants."""
    df = use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of the ``events`` stream by event type; ``event_id`` orders ticks inside a bar."""
    k = F.get_json_object("props", "$.k").cast("double")
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc(unit, "ts").alias("timestamp"),
        "event_id",
        "value",
        k.alias("k"),
        (F.col("user_id") % 2 == 0).alias("taker"),
    )
    taken = F.when(F.col("taker"), F.col("k")).otherwise(0.0)
    return ticks.groupBy("symbol", "timestamp").agg(
        F.min_by("value", "event_id").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"),
        F.sum("k").alias("volume"),
        F.sum(F.col("value") * F.col("k")).alias("quote_asset_volume"),
        F.count(F.lit(1)).alias("number_of_trades"),
        F.sum(taken).alias("taker_buy_base_vol"),
        F.sum(F.col("value") * taken).alias("taker_buy_quote_vol"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of the order ledger."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    price = F.col("o_totalprice") / 1000.0
    state = (
        F.when(status == "F", "SETTLED").when(status == "O", "OPEN").when(key % 3 == 0, "NEW")
        .when(key % 3 == 1, "ASSIGNED").otherwise("FAILED")
    )
    unassigned = (status == "P") & (key % 3 == 0)
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(key % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
        ((key % 50 + 1) / 1000.0).alias("quantity"),
        F.lit(0.1).alias("kelly_rate"),
        (key % 3 + 1).cast("int").alias("leverage"),
        state.alias("status"),
        F.when(~unassigned, F.concat(F.lit("acct_"), (F.col("o_custkey") % 4).cast("string"))).alias("assigned_account"),
        F.when(status.isin("F", "O"), price).alias("entry_price"),
        F.when(status == "F", price * (1 + (key % 21 - 10) / 1000.0)).alias("exit_price"),
        F.when(status == "F", 0.0005 * price).alias("commission"),
        (key % 7).cast("int").alias("retry_count"),
        F.unix_timestamp("o_orderdate").alias("created_at"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account trades: the executions of every order, one leg each."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "ENTRY").otherwise("EXIT").alias("leg"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs, one row per event."""
    return predictions_of(table(spark, sf_dir, "events"))


def predictions_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")

    def spread(base: float, prime: int) -> Column:
        return F.lit(base) + (e * prime % 200) / 100.0

    return events.select(
        e.alias("id"),
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("timestamp"),
        (F.col("value") + 100.0).alias("cur_price"),
        (e * 7919 % 1000 / 1000.0).alias("t_trmt_out"),
        (e * 104729 % 1000 / 1000.0).alias("t_ctrl_out"),
        spread(3.0, 31).alias("trmt_return_1h_out"),
        spread(3.0, 37).alias("ctrl_return_1h_out"),
        spread(1.0, 41).alias("trmt_sigma_1h_out"),
        spread(1.0, 43).alias("ctrl_sigma_1h_out"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-store records, one per event, with JSON payloads."""
    v = F.col("value").cast("decimal(12,2)").cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("request_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "ple").otherwise("dragonnet").alias("model_name"),
        F.concat(F.lit('{"open":'), v, F.lit(',"close":'), v, F.lit("}")).alias("ohlcv_data"),
    )


def evalset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("y_pred"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y_true"))
    return labels.join(docs, "doc_id")
