"""Order-ledger reports. Every one is a filter, one aggregate or a top-k over the order table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import ACTIVE, DIRECTIONS, STATUSES


def _newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc())


def check_status(status: str) -> str:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}, expected one of {STATUSES}")
    return status


def valid_domain(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose direction and status are of the allowed values, and the rest."""
    ok = F.coalesce(F.col("direction").isin(DIRECTIONS) & F.col("status").isin(STATUSES), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def priced() -> Column:
    return (F.col("entry_price") > 0) & (F.col("exit_price") > 0)


def long_pnl() -> Column:
    """Price difference times quantity whatever the direction; only rows with both prices."""
    return F.when(priced(), (F.col("exit_price") - F.col("entry_price")) * F.col("quantity"))


def directed_pnl() -> Column:
    gain = (F.col("exit_price") - F.col("entry_price")) * F.col("quantity")
    return F.when(F.col("direction") == "LONG", gain).when(F.col("direction") == "SHORT", -gain)


def order_stats(orders: DataFrame) -> DataFrame:
    """Counts in total and by status, direction, symbol and account: one pass over grouping sets."""
    by = ["status", "direction", "symbol", "assigned_account"]
    counted = orders.groupingSets([*[[c] for c in by], []], *by).agg(
        F.grouping_id().alias("_id"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("status").isin(ACTIVE)).alias("active_orders"),
        F.count_if(F.col("status") == "CLOSED").alias("closed_orders"),
        F.count_if(F.col("status") == "FAILED").alias("failed_orders"),
        F.min("created_at").alias("first_created"),
        F.max("created_at").alias("last_created"),
    )
    gid = F.col("_id")
    kind = F.when(gid == 7, "status").when(gid == 11, "direction").when(gid == 13, "symbol").when(gid == 14, "account").otherwise("total")
    named = counted.select(kind.alias("kind"), F.coalesce(*by).alias("name"), *counted.columns[5:])
    # rows without an account or direction take no part in those two counts
    return named.filter((F.col("kind") == "total") | F.col("name").isNotNull()).fillna("", ["name"])


def latest(orders: DataFrame, n: int = 10, status: str | None = None, symbol: str | None = None) -> DataFrame:
    if status is not None:
        orders = orders.filter(F.col("status") == status)
    if symbol is not None:
        orders = orders.filter(F.col("symbol") == symbol)
    return _newest(orders).limit(n)


def by_status(orders: DataFrame, status: str) -> DataFrame:
    return _newest(orders.filter(F.col("status") == check_status(status)))


def by_symbol(orders: DataFrame, symbol: str) -> DataFrame:
    return _newest(orders.filter(F.col("symbol") == symbol))


def by_account(orders: DataFrame, account: str) -> DataFrame:
    return _newest(orders.filter(F.col("assigned_account") == account))


def by_id(orders: DataFrame, order_id: int) -> DataFrame:
    return orders.filter(F.col("id") == order_id)


def _day_start(text: str) -> int:
    try:
        return int(datetime.strptime(text, "%Y%m%d").replace(tzinfo=timezone.utc).timestamp())
    except ValueError:
        raise ValueError(f"dates are YYYYMMDD, got {text!r}") from None


def by_date_range(orders: DataFrame, start: str, end: str) -> DataFrame:
    """Days YYYYMMDD in UTC, the first second of the day after ``end`` included."""
    return _newest(orders.filter(F.col("created_at").between(_day_start(start), _day_start(end) + 86400)))


def active(orders: DataFrame) -> DataFrame:
    return _newest(orders.filter(F.col("status").isin(ACTIVE)))


def failed(orders: DataFrame, limit: int = 100) -> DataFrame:
    return _newest(orders.filter(F.col("status") == "FAILED")).limit(limit)


def in_status(orders: DataFrame, status: str) -> DataFrame:
    """Unordered life-cycle slice, the input of the settlement and exit jobs."""
    return orders.filter(F.col("status") == check_status(status))


def pnl_summary(orders: DataFrame) -> DataFrame:
    return orders.filter(priced()).agg(
        F.count(F.lit(1)).alias("closed_count"),
        F.round(F.coalesce(F.avg("commission"), F.lit(0.0)), 8).alias("avg_commission"),
        F.round(F.coalesce(F.sum(long_pnl()), F.lit(0.0)), 2).alias("total_pnl"),
    )


def pnl_by_account(orders: DataFrame) -> DataFrame:
    """Settled orders, direction-aware, fees off; the row without an account is the total."""
    net = directed_pnl() - F.coalesce(F.col("commission"), F.lit(0.0))
    return (
        orders.filter(F.col("status") == "SETTLED")
        .rollup("assigned_account")
        .agg(
            F.grouping("assigned_account").cast("int").alias("is_total"),
            F.coalesce(F.sum(net), F.lit(0.0)).alias("pnl"),
            F.count(F.lit(1)).alias("trades"),
        )
    )


def account_stats(orders: DataFrame, account: str | None = None) -> DataFrame:
    """Per account; naming one that has no orders is an error at run time."""
    rows = orders.filter(F.col("assigned_account").isNotNull())
    if account is not None:
        rows = rows.filter(F.col("assigned_account") == account)
    out = rows.groupBy("assigned_account").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("status").isin(ACTIVE)).alias("active_orders"),
        F.count_if(F.col("status") == "CLOSED").alias("closed_orders"),
        F.count_if(F.col("status") == "FAILED").alias("failed_orders"),
        F.round(F.coalesce(F.avg("leverage"), F.lit(0.0)), 1).alias("avg_leverage"),
        F.round(F.coalesce(F.sum(long_pnl()), F.lit(0.0)), 2).alias("total_pnl"),
    )
    if account is not None and out.isEmpty():
        raise ValueError(f"account {account} has no orders")
    return out


def listing(orders: DataFrame, start: int, end: int) -> DataFrame:
    """Orders created in [start, end] epoch seconds with net PnL and hold time in whole minutes."""
    gain = (F.col("exit_price") - F.col("entry_price")) * F.col("quantity")
    pnl = F.when(F.col("direction") == "LONG", gain).otherwise(-gain) - F.col("commission")
    held = F.when(
        (F.col("created_at") > 0) & (F.col("close_time") > 0), F.floor((F.col("close_time") - F.col("created_at")) / 60)
    )
    shown = orders.filter(F.col("created_at").between(start, end)).select(
        "id", F.col("assigned_account").alias("account"), "symbol", "direction", "quantity", "entry_price",
        "exit_price", "status", "commission", "created_at", "close_time", pnl.alias("pnl"), held.alias("hold_minutes"),
    )
    return shown.orderBy("created_at", "id")


# -- exchange snapshots ---------------------------------------------------------------------------

TAKER_FEE = 0.0005
MARGIN_SAFETY = 1.05


def _two_sides(df: DataFrame, side: str, value: Column) -> DataFrame:
    """Sum per account with one column a direction; accounts without a side read 0."""
    return df.groupBy("account").agg(
        *[F.coalesce(F.sum(F.when(F.col(side) == d, value)), F.lit(0.0)).alias(d) for d in DIRECTIONS]
    )


def realized_pnl(trades: DataFrame) -> DataFrame:
    return _two_sides(trades, "positionSide", F.col("realizedPnl") - F.col("commission"))


def unrealized_pnl(positions: DataFrame, fee: float = TAKER_FEE) -> DataFrame:
    amt, mark = F.col("positionAmt"), F.col("markPrice")
    value = (mark - F.col("entryPrice")) * amt - F.abs(amt) * mark * fee
    return _two_sides(positions.filter(amt != 0), "positionSide", value)


def total_estimated_pnl(trades: DataFrame, positions: DataFrame) -> DataFrame:
    r = realized_pnl(trades).alias("r")
    u = unrealized_pnl(positions).alias("u")
    zero = F.lit(0.0)
    return r.join(u, "account", "full").select(
        "account", *[(F.coalesce(F.col(f"r.{d}"), zero) + F.coalesce(F.col(f"u.{d}"), zero)).alias(d) for d in DIRECTIONS]
    )


def position_notional(positions: DataFrame) -> DataFrame:
    return (
        positions.filter(F.col("positionAmt") != 0)
        .groupBy("account")
        .agg(F.sum(F.abs("positionAmt") * F.col("markPrice")).alias("notional"))
    )


def current_position(positions: DataFrame, order: str = "seq", residual: bool = False) -> DataFrame:
    """The last reported amount per account and side, signed, or absolute as ``residual``."""
    amt = F.abs("positionAmt") if residual else F.col("positionAmt")
    return positions.groupBy("account").agg(
        *[
            F.coalesce(F.max_by(F.when(F.col("positionSide") == d, amt), F.when(F.col("positionSide") == d, F.col(order))), F.lit(0.0)).alias(d)
            for d in DIRECTIONS
        ]
    )


def available_balance(balances: DataFrame, asset: str = "USDT") -> DataFrame:
    held = F.sum(F.when(F.col("asset") == asset, F.col("availableBalance")))
    return balances.groupBy("account").agg(F.coalesce(held, F.lit(0.0)).alias("available"))


def total_assets(balances: DataFrame, positions: DataFrame, mark_price: float) -> DataFrame:
    """Balance plus notional per account, in quote and in base units (a mark of 0 or less gives 0)."""
    total = F.col("available") + F.coalesce("notional", F.lit(0.0))
    base = total / F.lit(float(mark_price)) if mark_price > 0 else F.lit(0.0)
    return (
        available_balance(balances)
        .join(position_notional(positions), "account", "left")
        .select("account", total.alias("total_asset"), base.alias("total_asset_btc"))
    )


def total_assets_sum(balances: DataFrame, positions: DataFrame, mark_price: float) -> DataFrame:
    return total_assets(balances, positions, mark_price).agg(F.coalesce(F.sum("total_asset_btc"), F.lit(0.0)).alias("total_asset_btc"))


# -- fills and updates ----------------------------------------------------------------------------


def fill_prices(trades: DataFrame, *keys: str) -> DataFrame:
    """Quantity-weighted price and commission per key; partial sums combine map-side."""
    qty = F.abs("qty")
    return trades.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(qty * F.col("price")), F.sum(qty)), F.lit(0.0)).alias("avg_price"),
        F.sum(F.coalesce("commission", F.lit(0.0))).alias("commission"),
        F.count(F.lit(1)).alias("trades"),
    )


def apply_updates(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the given fields by id; a field that is NULL in ``updates`` keeps its value."""
    fields = [c for c in updates.columns if c != "id"]
    u = updates.select("id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = orders.join(u, "id", "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).cast(orders.schema[c].dataType).alias(c) if c in fields else F.col(c) for c in orders.columns]
    )


def increment_retry(orders: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(1))
    return orders.join(hit, "id", "left").withColumn("retry_count", F.col("retry_count") + F.coalesce("_hit", F.lit(0))).drop("_hit").select(*orders.columns)


def mark_failed(orders: DataFrame, reasons: DataFrame) -> DataFrame:
    return apply_updates(orders, reasons.select("id", F.lit("FAILED").alias("status"), F.col("reason").alias("failed_reason")))


# Retries allowed per stage, and the reason texts.
MAX_RETRY = {"ASSIGNED": 5, "OPEN": 20, "CLOSED": 5}
MAX_RETRY_REASON = "Max attempts hit"
NO_ACCOUNT_REASON = "No elegible account found"
ACCOUNT_MISSING_REASON = "Assigned account not found"


def exhaust_retries(orders: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Orders out of retries for their stage become FAILED, the earlier reason kept after a dot."""
    hit = F.lit(False)
    for status, limit in (limits or MAX_RETRY).items():
        hit = hit | ((F.col("status") == status) & (F.coalesce("retry_count", F.lit(0)) >= limit))
    # an absent earlier reason prints as None, as the reference writes it
    reason = F.concat(F.lit(MAX_RETRY_REASON + "."), F.coalesce("failed_reason", F.lit("None")))
    return orders.withColumns(
        {"failed_reason": F.when(hit, reason).otherwise(F.col("failed_reason")), "status": F.when(hit, "FAILED").otherwise(F.col("status"))}
    )
