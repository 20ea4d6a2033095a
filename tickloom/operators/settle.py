"""Settlement, exits and what routing asks of accounts: the joins around the order ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import floor_to
from tickloom.operators.ledger import ACCOUNT_MISSING_REASON, ACTIVE, MARGIN_SAFETY, fill_prices

TRADES_MISSING_REASON = "Trades not ready or unavailable"
BAD_PRICE_REASON = "Invalid price detected"
MAX_HOLD_SECONDS = 3600


def settle(closed: DataFrame, fills: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """CLOSED orders with their real prices and fees.

    ``fills`` hold one row per execution with ``order_id`` and ``leg``; they are summed per order before
    the join, both legs in one aggregate, so the join is one to one. An order whose account is unknown,
    whose legs are not both there or whose prices are not positive stays CLOSED with one more retry.
    """
    legs = fill_prices(fills, "order_id", "leg")

    def of(leg: str, c: str):
        return F.max(F.when(F.col("leg") == leg, F.col(c)))

    per_order = legs.groupBy("order_id").agg(
        of("ENTRY", "avg_price").alias("_entry"),
        of("EXIT", "avg_price").alias("_exit"),
        F.sum("commission").alias("_fee"),
    )
    rows = closed.join(per_order, closed["id"] == per_order["order_id"], "left").drop("order_id")
    known = F.lit(True)
    if accounts is not None:
        named = accounts.select(F.col("account").alias("assigned_account")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(named, "assigned_account", "left")
        known = F.coalesce("_known", F.lit(False))
    there = F.col("_entry").isNotNull() & F.col("_exit").isNotNull()
    good = (F.col("_entry") > 0) & (F.col("_exit") > 0)
    reason = (
        F.when(~known, F.lit(ACCOUNT_MISSING_REASON))
        .when(~there, F.lit(TRADES_MISSING_REASON))
        .when(~good, F.lit(BAD_PRICE_REASON))
    )
    ok = known & there & good
    changed = {
        "status": F.when(ok, "SETTLED").otherwise("CLOSED"),
        "entry_price": F.when(ok, F.col("_entry")).otherwise(F.col("entry_price")),
        "exit_price": F.when(ok, F.col("_exit")).otherwise(F.col("exit_price")),
        "commission": F.when(ok, F.col("_fee")).otherwise(F.col("commission")),
        "retry_count": F.when(ok, 0).otherwise(F.coalesce("retry_count", F.lit(0)) + 1),
        "failed_reason": F.when(~ok, reason).otherwise(F.col("failed_reason") if "failed_reason" in closed.columns else F.lit(None)),
    }
    names = [*closed.columns, *[c for c in changed if c not in closed.columns]]
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in names])


def _stop_hit(price: str):
    has_stop = F.col("stop_loss").isNotNull() & (F.col("stop_loss") != 0)
    below = (F.col("direction") == "LONG") & (F.col(price) <= F.col("stop_loss"))
    above = (F.col("direction") == "SHORT") & (F.col(price) >= F.col("stop_loss"))
    return F.coalesce(has_stop & (below | above), F.lit(False))


def exit_now(open_orders: DataFrame, prices: DataFrame, now: int, price: str = "cur_price") -> DataFrame:
    """Live test: held an hour, or stop crossed by the latest price. ``prices`` has one row per symbol."""
    rows = open_orders.join(prices.select("symbol", F.col(price).alias("_mark")), "symbol", "left")
    late = F.lit(now) - F.col("open_time") >= MAX_HOLD_SECONDS
    why = F.when(late, F.lit("time")).when(_stop_hit("_mark"), F.lit("stop"))
    return rows.withColumn("exit_reason", why).withColumn("should_close", why.isNotNull()).drop("_mark")


def _crossing(ranges: str, start: Column, end: Column) -> Column:
    """The entries (at, low, high) of a list between ``start`` and ``end`` that cross the order's stop, in the list's order."""
    of = lambda hit: F.filter(ranges, lambda r: hit(r) & r["at"].between(start, end))
    below, above = of(lambda r: r["low"] <= F.col("stop_loss")), of(lambda r: r["high"] >= F.col("stop_loss"))
    return F.when(F.col("direction") == "LONG", below).when(F.col("direction") == "SHORT", above)


def first_exit(open_orders: DataFrame, bars: DataFrame, now: int, price: str = "close") -> DataFrame:
    """When each order should have been closed, over price history: the first bar in its first hour that
    crosses the stop, else the end of that hour if ``now`` has passed it.

    Bars become the low and the high of every second, lists of them by minute, and lists of the minutes by
    hour with the next hour, so no list grows with the number of bars. An order meets one list of minutes and
    looks into at most two of them: the first that crosses and, as that one may cross before the order was
    opened, the next. ``exit_at`` is in whole seconds.
    """
    low, high = F.min("low").alias("low"), F.max("high").alias("high")
    at = F.unix_timestamp("timestamp").alias("at")
    seconds = bars.groupBy("symbol", at).agg(F.min(price).alias("low"), F.max(price).alias("high"))
    minutes = seconds.groupBy("symbol", F.floor(F.col("at") / 60).alias("_minute")).agg(F.collect_list(F.struct("at", "low", "high")).alias("_seconds"), low, high)
    hour = F.floor(F.col("_minute") / 60)
    hours = (
        minutes.select("symbol", F.struct(F.col("_minute").alias("at"), "low", "high").alias("_one"), F.explode(F.array(hour - 1, hour)).alias("_hour"))
        .groupBy("symbol", "_hour")
        .agg(F.sort_array(F.collect_list("_one")).alias("_minutes"))
    )
    opened, until = F.col("open_time"), F.col("open_time") + MAX_HOLD_SECONDS
    orders = open_orders.filter(F.coalesce(F.col("stop_loss") != 0, F.lit(False))).select(
        "id", "symbol", "direction", "stop_loss", "open_time",
        F.floor(opened / 3600).alias("_hour"), F.floor(opened / 60).alias("_first"), F.floor(until / 60).alias("_last"),
    )
    two = F.slice(_crossing("_minutes", F.col("_first"), F.col("_last"))["at"], 1, 2)
    # outer: an inner explode would add a filter that works the list out twice; the join drops its null minutes
    asked = orders.join(hours, ["symbol", "_hour"]).select("id", "symbol", "direction", "stop_loss", "open_time", F.explode_outer(two).alias("_minute"))
    hits = (
        asked.join(minutes.select("symbol", "_minute", "_seconds"), ["symbol", "_minute"])
        .groupBy("id")
        .agg(F.min(F.array_min(_crossing("_seconds", opened, until)["at"])).alias("_stop_at"))
    )
    timed = F.when(until <= F.lit(now), until)
    stopped = F.when(F.col("_stop_at") <= F.lit(now), F.col("_stop_at"))
    reason = F.when(stopped.isNotNull() & (timed.isNull() | (stopped < timed)), "stop").when(timed.isNotNull(), "time")
    return (
        open_orders.join(hits, "id", "left")
        .withColumn("exit_at", F.least(timed, stopped))
        .withColumn("exit_reason", reason)
        .drop("_stop_at")
    )


# -- routing --------------------------------------------------------------------------------------

def eligible_accounts(accounts: DataFrame, orders: DataFrame) -> DataFrame:
    """(account, direction, available): no active order and no position in that direction.

    ``accounts``: account, available, and the current position as LONG and SHORT.
    """
    sides = accounts.select(
        "account", "available", F.inline(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(d).alias("_pos")) for d in ("LONG", "SHORT")]))
    )
    busy = (
        orders.filter(F.col("status").isin(ACTIVE) & F.col("assigned_account").isNotNull())
        .select(F.col("assigned_account").alias("account"), "direction")
        .distinct()
    )
    return sides.filter(F.col("_pos") == 0).drop("_pos").join(busy, ["account", "direction"], "left_anti")


def needs(new_orders: DataFrame, total_btc: float, mark_price: float) -> DataFrame:
    """New orders with their quantity and the margin it takes."""
    qty = floor_to(F.col("kelly_rate") * F.lit(float(total_btc)), 3)
    lev = F.when(F.coalesce("leverage", F.lit(0)) == 0, 1).otherwise(F.col("leverage"))
    return new_orders.withColumn("_qty", qty).withColumn("_margin", F.col("_qty") * F.lit(float(mark_price)) / lev * MARGIN_SAFETY)
