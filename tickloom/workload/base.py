"""Registry and the SQL form of the shared views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int | None = 6):
    """Register a query under its function name. Doubles are rounded to ``digits`` on both sides, because
    the two engines add in different orders."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out if digits is None else rounded(out, digits)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def nudge(digits: int) -> float:
    """Moves exact rounding ties, which the engines' last bits would break either way, off the boundary."""
    return 1.3e-3 * 10.0**-digits


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`") + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rd(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL text of a rounded column, negative zero normalised."""
    return f'round(({expr}) + {nudge(digits)!r}::double, {digits}) + 0.0::double as "{name or expr}"'


def rds(names: list[str], digits: int = 6) -> str:
    return ", ".join(rd(f'"{n}"', n, digits) for n in names)


BARS = """
ticks as (
  select event_type as symbol, date_trunc('hour', ts) as timestamp, event_id, value, user_id,
         cast(json_extract_string(props, '$.k') as double) as k
  from events),
bars as (
  select symbol, timestamp, min_by(value, event_id) as open, max(value) as high, min(value) as low,
         max_by(value, event_id) as close, sum(k) as volume, sum(value * k) as quote_asset_volume,
         count(*) as number_of_trades, sum(case when user_id % 2 = 0 then k else 0 end) as taker_buy_base_vol,
         sum(case when user_id % 2 = 0 then value * k else 0 end) as taker_buy_quote_vol
  from ticks group by 1, 2),
base as (
  select *, quote_asset_volume / nullif(volume, 0) as vwap,
         coalesce(close / nullif(lag(close) over (partition by symbol order by timestamp), 0) - 1, 0) as returns
  from bars)"""

LEDGER = """
ledger as (
  select o_orderkey as id, o_orderpriority as symbol,
         case when o_orderkey % 2 = 0 then 'LONG' else 'SHORT' end as direction,
         (o_orderkey % 50 + 1) / 1000.0::double as quantity, 0.1::double as kelly_rate,
         cast(o_orderkey % 3 + 1 as int) as leverage,
         case when o_orderstatus = 'F' then 'SETTLED' when o_orderstatus = 'O' then 'OPEN'
              when o_orderkey % 3 = 0 then 'NEW' when o_orderkey % 3 = 1 then 'ASSIGNED' else 'FAILED' end as status,
         case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then null
              else concat('acct_', cast(o_custkey % 4 as varchar)) end as assigned_account,
         case when o_orderstatus in ('F', 'O') then o_totalprice / 1000.0::double end as entry_price,
         case when o_orderstatus = 'F'
              then o_totalprice / 1000.0::double * (1 + (o_orderkey % 21 - 10) / 1000.0::double) end as exit_price,
         case when o_orderstatus = 'F' then 0.0005::double * (o_totalprice / 1000.0::double) end as commission,
         cast(o_orderkey % 7 as int) as retry_count,
         cast(epoch(o_orderdate) as bigint) as created_at
  from orders)"""

FILLS = """
fills as (
  select l_orderkey as order_id, case when l_linenumber % 2 = 1 then 'ENTRY' else 'EXIT' end as leg,
         l_quantity as qty, l_extendedprice / l_quantity as price, l_extendedprice * l_tax as commission
  from lineitem)"""

PREDICTIONS = """
predictions as (
  select event_id as id, event_type as symbol, ts as timestamp, value + 100 as cur_price,
         (event_id * 7919 % 1000) / 1000.0::double as t_trmt_out, (event_id * 104729 % 1000) / 1000.0::double as t_ctrl_out,
         3.0::double + (event_id * 31 % 200) / 100.0::double as trmt_return_1h_out,
         3.0::double + (event_id * 37 % 200) / 100.0::double as ctrl_return_1h_out,
         1.0::double + (event_id * 41 % 200) / 100.0::double as trmt_sigma_1h_out,
         1.0::double + (event_id * 43 % 200) / 100.0::double as ctrl_sigma_1h_out
  from events)"""

RECORDS = """
records as (
  select concat('req_', cast(event_id as varchar)) as request_id, event_id as seq, ts as timestamp,
         event_type as symbol, case when user_id % 2 = 0 then 'ple' else 'dragonnet' end as model_name,
         concat('{"open":', cast(cast(value as decimal(12,2)) as varchar), ',"close":',
                cast(cast(value as decimal(12,2)) as varchar), '}') as ohlcv_data
  from events)"""

EVALSET = """
evalset as (
  select doc_id, cast(quality as double) as y_true, cast(n_chars as double) as y_pred
  from labels join documents using (doc_id))"""

TS = "cast(epoch(timestamp) as bigint) as bar_ts"


def seconds(df: DataFrame, column: str = "timestamp", out: str = "bar_ts") -> DataFrame:
    """Timestamps as epoch seconds, which both engines print alike."""
    return df.select(*[F.unix_timestamp(c).alias(out) if c == column else F.col(f"`{c}`") for c in df.columns])


def win(fn: str, x: str, w: int) -> str:
    """SQL of a full trailing frame: NULL until ``w`` rows are there."""
    over = f"over (partition by symbol order by timestamp rows between {w - 1} preceding and current row)"
    return f"(case when count({x}) {over} = {w} then {fn}({x}) {over} end)"


def win2(fn: str, x: str, y: str, w: int) -> str:
    over = f"over (partition by symbol order by timestamp rows between {w - 1} preceding and current row)"
    return f"(case when count({x} + {y}) {over} = {w} then {fn}({x}, {y}) {over} end)"


def lag(x: str, p: int = 1) -> str:
    return f"(lag({x}, {p}) over (partition by symbol order by timestamp))"


def delta(x: str, p: int = 1) -> str:
    return f"({x} - {lag(x, p)})"


def pct(x: str, p: int = 1) -> str:
    return f"({x} / nullif({lag(x, p)}, 0) - 1)"


def zero(x: str) -> str:
    return f"(case when {x} is null or isnan({x}) or isinf({x}) then 0.0::double else {x} end)"


def rank_of_last(x: str, w: int) -> str:
    over = f"over (partition by symbol order by timestamp rows between {w - 1} preceding and current row)"
    return (
        f"(case when count({x}) {over} = {w} then "
        f"len(list_filter(list({x}) {over}, lambda v: v < {x})) + (len(list_filter(list({x}) {over}, lambda v: v = {x})) + 1) / 2.0::double end)"
    )
