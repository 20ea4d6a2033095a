"""Explicit schemas of the stored tables. Sources are read with these, never with inference."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "matrix": T.ArrayType(T.ArrayType(T.FloatType())),
}


def _struct(text: str) -> T.StructType:
    """Usable before a session exists, unlike DDL strings."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BARS = _struct(
    "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double, "
    "quote_asset_volume double, number_of_trades bigint, taker_buy_base_vol double, taker_buy_quote_vol double"
)
# One exchange kline: twelve positions, numbers as text.
KLINE_FIELDS = [
    "timestamp", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume",
    "number_of_trades", "taker_buy_base_vol", "taker_buy_quote_vol", "ignore",
]
KLINES = _struct(
    "symbol string, interval string, timestamp timestamp, open string, high string, low string, close string, "
    "volume string, close_time timestamp, quote_asset_volume string, number_of_trades bigint, "
    "taker_buy_base_vol string, taker_buy_quote_vol string, ingest_ts timestamp"
)
RECORDS = _struct(
    "request_id string, timestamp timestamp, symbol string, model_name string, ohlcv_data string, "
    "features matrix, model_output string, created_at timestamp, dt date"
)
ORDERS = _struct(
    "id bigint, symbol string, direction string, quantity double, kelly_rate double, leverage int, stop_loss double, "
    "status string, assigned_account string, entry_order_id string, exit_order_id string, open_time bigint, "
    "close_time bigint, entry_price double, exit_price double, commission double, retry_count int, "
    "failed_reason string, created_at bigint"
)
SCORES = _struct(
    "id bigint, timestamp bigint, final_score double, quantile double, direction string, leverage double, "
    "cur_price double, stop_loss_price double, position_ratio double, is_valid boolean, fail_reason string"
)

# The order life cycle and the two directions.
STATUSES = ["NEW", "ASSIGNED", "OPEN", "CLOSED", "FAILED", "SETTLED"]
ACTIVE = ["ASSIGNED", "OPEN"]
DIRECTIONS = ["LONG", "SHORT"]
