"""Bars: storage reports, window primitives, features, vectors."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.layout import HALO, Chunking, chunked, tail_rows
from tickloom.functions.rolling import Rolling, lookback
from tickloom.operators import alphas, columns, features
from tickloom.plans import views
from tickloom.sources import bars as src
from tickloom.workload.base import BARS, TS, delta, lag, pct, query, rank_of_last, rd, rds, seconds, win, win2, zero

HOURS = Chunking(micro_seconds=86_400 * 7)
SMALL_CHUNKS = Chunking(rows=200, micro_seconds=86_400)  # several chunks a symbol on the sample tables
NUMBERS = ["open", "high", "low", "close", "volume", "quote_asset_volume", "taker_buy_base_vol", "taker_buy_quote_vol"]


@query(f"with {BARS} select symbol, {TS}, number_of_trades, {rds(NUMBERS)} from bars")
def bars_hourly(spark, d):
    return seconds(views.bars(spark, d))


@query(f"""with {BARS} select symbol, {TS}, {rds(["close"])} from bars
where timestamp between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-20 18:00:00'""")
def bars_time_range(spark, d):
    """S-2, S-11: both ends inclusive, floored to the minute."""
    out = src.time_range(views.bars(spark, d), "2024-01-05 06:00:30", "2024-01-20 18:00:59")
    return seconds(out.select("symbol", "timestamp", "close"))


@query(f"""with {BARS},
r as (select * from bars where timestamp between timestamp '2024-01-02' and timestamp '2024-02-01'),
e as (select symbol, min(timestamp) as f, max(timestamp) as l from r group by 1),
g as (select symbol, lag(timestamp) over (partition by symbol order by timestamp) as b, timestamp as t from r),
u as (
  select symbol, timestamp '2024-01-02' as s, f - interval 1 hour as e from e where f > timestamp '2024-01-02'
  union all select symbol, b + interval 1 hour, t - interval 1 hour from g where t > b + interval 1 hour
  union all select symbol, l + interval 1 hour, timestamp '2024-02-01' from e where l < timestamp '2024-02-01')
select symbol, cast(epoch(s) as bigint) as gap_start, cast(epoch(e) as bigint) as gap_end from u""")
def bar_gaps(spark, d):
    """S-5: head, inner and tail gaps of a requested range."""
    gaps = src.missing_ranges(views.bars(spark, d), "2024-01-02", "2024-02-01", 60, HOURS)
    return gaps.select("symbol", F.unix_timestamp("gap_start").alias("gap_start"), F.unix_timestamp("gap_end").alias("gap_end"))


@query(f"""with {BARS} select symbol, count(*) as total_records, cast(epoch(min(timestamp)) as bigint) as earliest_time,
cast(epoch(max(timestamp)) as bigint) as latest_time,
{rd("round((epoch(max(timestamp)) - epoch(min(timestamp))) / 86400.0::double, 2)", "time_span_days")} from bars group by 1""")
def cache_stats(spark, d):
    out = src.cache_stats(views.bars(spark, d))
    return out.withColumns({c: F.unix_timestamp(c) for c in ("earliest_time", "latest_time")})


@query("""with v as (select event_type as symbol, date_trunc('hour', ts) as timestamp, value, event_id from events)
select symbol, cast(epoch(timestamp) as bigint) as bar_ts, max_by(value, event_id) as value, max(event_id) as version
from v group by symbol, timestamp""")
def upsert_latest(spark, d):
    """S-4: two overlapping loads; the newest version of a key wins."""
    v = views.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("timestamp"), "value", F.col("event_id").alias("version")
    )
    old, new = v.filter(F.col("version") % 3 != 0), v.filter(F.col("version") % 2 == 0).unionByName(v.filter(F.col("version") % 3 == 0))
    return seconds(src.upsert_latest(old, new, ("symbol", "timestamp"), "version"))


@query(f"""with {BARS} select symbol, count(*) as kept, cast(epoch(min(timestamp)) as bigint) as earliest_time from bars
where timestamp >= timestamp '2024-01-31' - interval 20160 minutes group by 1""")
def retention(spark, d):
    """S-8: bars of the last 20160 minutes before a given now."""
    kept = src.drop_expired(views.bars(spark, d), "2024-01-31 00:00:00", 20160)
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("kept"), F.unix_timestamp(F.min("timestamp")).alias("earliest_time"))


@query(f"""with {BARS} select symbol, cast(epoch(max(timestamp) + interval 1 hour) as bigint) as last_close_time,
max(timestamp) + interval 1 hour >= timestamp '2024-01-31' as fresh from bars group by 1""")
def freshness(spark, d):
    """S-10."""
    b = views.bars(spark, d).withColumn("close_time", F.col("timestamp") + F.expr("interval 1 hour"))
    return src.freshness(b, "2024-01-31 00:00:40").withColumn("last_close_time", F.unix_timestamp("last_close_time"))


@query("""select event_type as symbol, epoch_us(ts) // 1000000 as bar_ts,
value as open, value as close, cast(json_extract_string(props, '$.k') as double) as volume, user_id as number_of_trades from events""")
def kline_parse(spark, d):
    """S-3: twelve-field JSON klines to typed bars."""
    e = views.table(spark, d, "events")
    v, k = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    zero_text = F.lit("0")
    fields = [
        F.unix_millis("ts").cast("string"), v, v, v, v, k, F.unix_millis("ts").cast("string"), zero_text,
        F.col("user_id").cast("string"), zero_text, zero_text, zero_text,
    ]
    raw = e.select(F.col("event_type").alias("symbol"), F.to_json(F.array(F.array(*fields))).alias("klines"))
    out = src.parse_klines(raw).select("symbol", "timestamp", "open", "close", "volume", "number_of_trades")
    return seconds(out)


@query(f"""with {BARS}, n as (select *, row_number() over (partition by symbol order by timestamp desc) as rn from bars)
select symbol, {TS}, {rds(["close", "volume"])} from n where rn <= 101""")
def tail_per_symbol(spark, d):
    """V-6: the last N + 1 bars of every symbol."""
    return seconds(tail_rows(views.bars(spark, d), 101, HOURS).select("symbol", "timestamp", "close", "volume"))


@query(f"with {BARS} select symbol, {rd('max_by(close, timestamp)', 'cur_price')} from bars group by 1")
def latest_close(spark, d):
    return src.latest_close(views.bars(spark, d))


@query("""with w as (select unnest(['click', 'view', 'refund', 'chargeback']) as symbol)
select w.symbol, e.symbol is null as missing, coalesce(e.n, 0) as n_rows from w
left join (select event_type as symbol, count(*) as n from events group by 1) e using (symbol)""")
def symbol_subset(spark, d):
    """V-5: wanted symbols, and the report of those not there."""
    e = views.table(spark, d, "events").select(F.col("event_type").alias("symbol"))
    wanted = e.sparkSession.createDataFrame([("click",), ("view",), ("refund",), ("chargeback",)], "symbol string")
    found = src.wanted_symbols(e, wanted).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    gone = src.missing_symbols(e, wanted).select("symbol", F.lit(0).cast("bigint").alias("n_rows"))
    return found.withColumn("missing", F.lit(False)).unionByName(gone.withColumn("missing", F.lit(True)))


@query(f"""with {BARS}, n as (select *, row_number() over (partition by symbol order by timestamp desc) as rn from bars)
select symbol, count(*) as n_bars, cast(epoch(min(timestamp)) as bigint) as first_ts, {rd("sum(close)", "sum_close")} from n where rn <= 100 group by 1""")
def snapshot_last_100(spark, d):
    """V-12: the last 100 bars as one array per symbol."""
    s = src.snapshot(views.bars(spark, d).select("symbol", "timestamp", "close"), 100, HOURS)
    total = F.aggregate("ohlcv", F.lit(0.0), lambda acc, r: acc + r["close"])
    first = F.unix_timestamp(F.element_at("ohlcv", 1)["timestamp"])
    return s.select("symbol", F.size("ohlcv").cast("bigint").alias("n_bars"), first.alias("first_ts"), total.alias("sum_close"))


# -- window primitives ----------------------------------------------------------------------------

_PREV = "over (partition by symbol order by timestamp rows between 60 preceding and 1 preceding)"
_STATS = ", ".join(
    rd(f"case when count({c}) {_PREV} = 60 then {fn}({c}) {_PREV} end", f"{c}_{tag}")
    for c in features.OHLCV
    for tag, fn in (("mean", "avg"), ("std", "stddev_samp"))
)


@query(f"with {BARS} select symbol, {TS}, {_STATS} from bars")
def prev_window_stats(spark, d):
    """W-21: statistics of the previous 60 rows, first valid at index 60."""
    out = features.previous_window_stats(views.bars(spark, d), 60, HOURS)
    return seconds(out.select("symbol", "timestamp", *[f"{c}_{t}" for c in features.OHLCV for t in ("mean", "std")]))


@query(f"""with {BARS} select symbol, cast(timestamp as date) as dt, count(*) as rows,
{rd("count(*) / 24.0::double * 100", "completeness_pct")}, count(*) < 21.6 as low from bars group by 1, 2""")
def completeness(spark, d):
    """W-22 at 24 expected bars a day."""
    return features.completeness(views.bars(spark, d), 24)


def _rolled(r, df, out):
    laid = chunked(df, lookback(out), SMALL_CHUNKS)
    return r.select(laid, out, keep=("symbol", "timestamp", HALO)).filter(~F.col(HALO)).drop(HALO)


_PRIMS = {
    "sum": win("sum", "close", 5), "avg": win("avg", "close", 5), "std": win("stddev_samp", "close", 5),
    "lo": win("min", "low", 5), "hi": win("max", "high", 5), "corr": win2("corr", "close", "volume", 6),
    "cov": win2("covar_samp", "close", "volume", 6), "prod": win("product", "(1 + returns / 100)", 4),
    "diff": delta("close", 3), "prev": lag("close", 2),
}


@query(f"with {BARS} select symbol, {TS}, {', '.join(rd(e, n, 4) for n, e in _PRIMS.items())} from base", 4)
def rolling_primitives(spark, d):
    """W-1..W-5, W-7..W-10 on plain frames."""
    r = Rolling()
    c, v = r.source("close"), r.source("volume")
    out = {
        "sum": r.sum(c, 5), "avg": r.mean(c, 5), "std": r.std(c, 5), "lo": r.min(r.source("low"), 5),
        "hi": r.max(r.source("high"), 5), "corr": r.corr(c, v, 6), "cov": r.cov(c, v, 6),
        "prod": r.product(r.source("returns") / 100.0 + 1.0, 4), "diff": r.delta(c, 3), "prev": r.lag(c, 2),
    }
    base = features.base_columns(views.bars(spark, d))
    return seconds(_rolled(r, base, out))


_WIDE = {
    "sum": win("sum", "close", 113), "avg": win("avg", "close", 113), "std": win("stddev_samp", "close", 113),
    "corr": win2("corr", "close", "volume", 113), "cov": win2("covar_samp", "close", "returns", 113),
    "lo": win("min", "low", 113), "hi": win("max", "high", 113),
}


@query(f"with {BARS} select symbol, {TS}, {', '.join(rd(e, n, 5) for n, e in _WIDE.items())} from base", 5)
def rolling_primitives_wide(spark, d):
    """The same by the Arrow pass."""
    r = Rolling()
    c, v = r.source("close"), r.source("volume")
    out = {
        "sum": r.sum(c, 113), "avg": r.mean(c, 113), "std": r.std(c, 113), "corr": r.corr(c, v, 113),
        "cov": r.cov(c, r.source("returns"), 113), "lo": r.min(r.source("low"), 113), "hi": r.max(r.source("high"), 113),
    }
    return seconds(_rolled(r, features.base_columns(views.bars(spark, d)), out))


_LOUD = f"""{BARS},
loud as (select symbol, timestamp, close, case when (epoch(timestamp) // 3600) % 97 = 0 then volume * 1e9::double else volume end as volume from bars),
quiet as (select *, max(volume) over (partition by symbol order by timestamp rows between 60 preceding and current row) < 1e8 as calm from loud)"""
_LOUD_ZSCORE = (
    "(volume - avg(volume) over (partition by symbol order by timestamp rows between 60 preceding and 1 preceding)) / "
    "nullif(stddev_samp(volume) over (partition by symbol order by timestamp rows between 60 preceding and 1 preceding), 0)"
)


@query(f"""with {_LOUD}, x as (select symbol, timestamp, calm, {win("avg", "volume", 60)} as mean, {win("stddev_samp", "volume", 60)} as std,
{win2("corr", "close", "volume", 60)} as corr, {win("sum", "volume", 40)} as total, {_LOUD_ZSCORE} as z from quiet)
select symbol, {TS}, {rds(["mean", "std", "corr", "total"])}, {rd("coalesce(z, 0)", "z_one")}, {rd("coalesce(z, 0)", "z_many")} from x where calm""")
def windows_after_outliers(spark, d):
    """W-1..W-4, W-17 where every 97th hour is 1e9 times as large: once out of the window, it must leave no trace,
    and the number of columns standardised together must not matter."""
    hour = F.floor(F.unix_timestamp("timestamp") / 3600)
    loud = views.bars(spark, d).select("symbol", "timestamp", "close", F.when(hour % 97 == 0, F.col("volume") * 1e9).otherwise(F.col("volume")).alias("volume"))
    r = Rolling()
    c, v = r.source("close"), r.source("volume")
    out = {"mean": r.mean(v, 60), "std": r.std(v, 60), "corr": r.corr(c, v, 60), "total": r.sum(v, 40), "_top": r.max(v, 61)}
    moments = _rolled(r, loud, out)
    one = features.rolling_z_score(loud.drop("close"), 60, chunking=SMALL_CHUNKS).withColumnRenamed("volume", "z_one")
    many = features.rolling_z_score(loud.select("*", *[(F.col("close") + i).alias(f"c{i}") for i in range(20)]), 60, chunking=SMALL_CHUNKS)
    found = moments.join(one, ["symbol", "timestamp"]).join(many.select("symbol", "timestamp", F.col("volume").alias("z_many")), ["symbol", "timestamp"])
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp"))
    early = F.max("volume").over(Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(-60, 0))
    first = loud.select("symbol", "timestamp", nth.alias("_nth"), early.alias("_early")).filter("_nth <= 60")
    found = found.join(first, ["symbol", "timestamp"], "left").filter(F.coalesce("_top", "_early") < 1e8)
    return seconds(found.drop("_top", "_nth", "_early"))


_L10 = "list(close) over (partition by symbol order by timestamp rows between 9 preceding and current row)"
_ARGS = ", ".join(
    f"case when count(close) over (partition by symbol order by timestamp rows between 9 preceding and current row) = 10 "
    f"then cast(list_position({_L10}, list_{fn}({_L10})) as double) end as arg{fn}"
    for fn in ("max", "min")
)


@query(f"with {BARS} select symbol, {TS}, {rd(rank_of_last('close', 10), 'rank')}, {_ARGS} from base")
def ts_rank_small(spark, d):
    """W-6, W-13."""
    r = Rolling()
    c = r.source("close")
    out = {"rank": r.rank(c, 10), "argmax": r.arg("max", c, 10), "argmin": r.arg("min", c, 10)}
    return seconds(_rolled(r, views.bars(spark, d), out))


@query(f"with {BARS} select symbol, {TS}, {rd(rank_of_last('volume', 90), 'rank')} from base")
def ts_rank_wide(spark, d):
    """W-6 by kernel."""
    r = Rolling()
    return seconds(_rolled(r, views.bars(spark, d), {"rank": r.rank(r.source("volume"), 90)}))


_WIDE = 5040


@query(f"""with t as (select event_id, value as v, value * (event_id % 7) as u, row_number() over (order by event_id) as i,
  list(value) over (order by event_id rows between {_WIDE - 1} preceding and current row) as l,
  list(1.0::double + (event_id % 5 - 2) / 4096.0::double) over (order by event_id rows between {_WIDE - 1} preceding and current row) as p from events)
select event_id, case when i >= {_WIDE} then len(list_filter(l, lambda x: x < v)) + (len(list_filter(l, lambda x: x = v)) + 1) / 2.0::double end as rank,
{rd(f"case when i >= {_WIDE} then len(list_filter(l[1 : {_WIDE - 1}], lambda x: x < v)) / {_WIDE - 1}.0::double end", "below")},
{rd(f"case when i >= {_WIDE} then list_product(p) end", "product")} from t""")
def order_statistics_wide(spark, d):
    """W-6, W-7, D-3 over 5,040 rows: all ticks as one series, cut in chunks."""
    e = views.table(spark, d, "events").select(F.lit("all").alias("symbol"), F.timestamp_seconds("event_id").alias("timestamp"), "event_id", "value", (1.0 + (F.col("event_id") % 5 - 2) / 4096.0).alias("factor"))
    r = Rolling()
    v, f = r.source("value"), r.source("factor")
    out = {"rank": r.rank(v, _WIDE), "below": r.kernel("share_below", v, _WIDE), "product": r.product(f, _WIDE)}
    laid = chunked(e, _WIDE - 1, Chunking(2000, 500))
    return r.select(laid, out, ("event_id", HALO)).filter(~F.col(HALO)).drop(HALO)


@query(f"""with {BARS} select symbol, {TS},
{rd("(rank() over (partition by symbol order by volume) + (count(*) over (partition by symbol, volume) - 1) / 2.0::double) / count(*) over (partition by symbol)", "rank")}
from bars""")
def pct_rank(spark, d):
    """W-11: percentile rank over the whole column, average ties."""
    return seconds(columns.pct_rank(views.bars(spark, d).select("symbol", "timestamp", "volume"), "volume").drop("volume"))


@query(f"""with {BARS} select symbol, {TS}, {rd("close * 100 / sum(abs(close)) over (partition by symbol)", "scaled")},
{rd("(close - min(close) over (partition by symbol)) / nullif(max(close) over (partition by symbol) - min(close) over (partition by symbol), 0)", "normed")} from bars""")
def scale_norm(spark, d):
    """W-12, W-15."""
    b = views.bars(spark, d).select("symbol", "timestamp", "close")
    return seconds(columns.norm(columns.scale(b, "close", 100.0), "close").drop("close"))


_DECAY = " + ".join(f"coalesce(lag(x, {i}) over w, 0) * {(5 - i)} / 15.0::double" for i in range(5))


@query(f"""with {BARS},
f as (select symbol, timestamp, coalesce(last_value(vwap ignore nulls) over (partition by symbol order by timestamp rows unbounded preceding),
  first_value(vwap ignore nulls) over (partition by symbol order by timestamp rows between current row and unbounded following), 0) as x from base)
select symbol, {TS}, {rd(f"case when row_number() over w < 5 then x else {_DECAY} end", "decayed")} from f window w as (partition by symbol order by timestamp)""")
def decay_linear(spark, d):
    """W-14, holes in vwap filled."""
    base = features.base_columns(views.bars(spark, d)).select("symbol", "timestamp", "vwap")
    return seconds(columns.decay_linear(base, "vwap", 5, chunking=HOURS).drop("vwap"))


_P30 = "over (partition by symbol order by timestamp rows between 30 preceding and 1 preceding)"
_P200 = "over (partition by symbol order by timestamp rows between 200 preceding and 1 preceding)"


def _z(x: str, frame: str) -> str:
    return f"coalesce(({x} - avg({x}) {frame}) / nullif(stddev_samp({x}) {frame}, 0), 0)"


@query(f"with {BARS} select symbol, {TS}, {rd(_z('close', _P30), 'close')}, {rd(_z('volume', _P30), 'volume')} from base")
def zscore_prev(spark, d):
    """W-17 on frames."""
    b = views.bars(spark, d).select("symbol", "timestamp", "close", "volume")
    return seconds(features.rolling_z_score(b, 30, chunking=HOURS))


@query(f"with {BARS} select symbol, {TS}, {rd(_z('close', _P200), 'close')}, {rd(_z('volume', _P200), 'volume')} from base")
def zscore_prev_wide(spark, d):
    """W-17 by the matrix pass."""
    b = views.bars(spark, d).select("symbol", "timestamp", "close", "volume")
    return seconds(features.rolling_z_score(b, 200, chunking=HOURS))


_VOL = "over (partition by symbol order by timestamp rows between 11 preceding and current row)"


@query(f"""with {BARS},
c as (select *, lag(close) over (partition by symbol order by timestamp) as b from base),
p as (select *, case when b is null or (b = 0 and close = 0) then 0 else close / nullif(b, 0) - 1 end as ch from c),
v as (select *, close / coalesce(nullif(stddev_samp(ch) {_VOL}, 0), 1) as x from p)
select symbol, {TS}, {rd(_z('x', _P30), 'close')} from v""")
def zscore_vol(spark, d):
    """W-18."""
    b = views.bars(spark, d).select("symbol", "timestamp", "close")
    return seconds(features.rolling_z_score_vol(b, 12, 30, chunking=HOURS))


@query(f"""with {BARS}, s as (select symbol, timestamp, avg(close) {_P30} as m, stddev_samp(close) {_P30} as s,
row_number() over (partition by symbol order by timestamp desc) as rn from bars)
select symbol, 'close' as "column", {rd("m", "mean")}, {rd("s", "std")} from s where rn = 1""")
def zscore_stats(spark, d):
    """W-17: what the newest row is standardised with."""
    return features.z_score_stats(views.bars(spark, d), 30, ["close"], HOURS)


@query(f"""with {BARS} select symbol, {TS}, {rd("(close - 100.0::double) / 50.0::double", "close")}, {rd("volume", "volume")} from bars""")
def zscore_static(spark, d):
    """W-19: given statistics; no deviation or no entry passes through."""
    b = views.bars(spark, d).select("symbol", "timestamp", "close", "volume")
    return seconds(features.z_score_static(b, {"close": {"mean": 100, "std": 50}, "volume": {"mean": 3, "std": 0}}))


@query("""select o_orderkey as id, strftime(o_orderdate - interval 7 day, '%Y-%m-%d') as earlier,
strftime(o_orderdate + interval 30 day, '%Y-%m-%d') as later from orders""")
def date_shift(spark, d):
    """W-20."""
    from tickloom.functions.scalars import minus_date, plus_date

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), minus_date(day, 7).alias("earlier"), plus_date(day, 30).alias("later")
    )


# -- alpha features -------------------------------------------------------------------------------


def _alphas(spark, d, config):
    """Features of a configuration over chunked bars, missing to 0."""
    out = alphas.compute(views.bars(spark, d), config, HOURS)
    names = [c for c, _, _ in alphas.tasks(config)]
    cleaned = features.zero_missing_columns(out.select("symbol", "timestamp", *[f"`{n}`" for n in names]))
    return seconds(cleaned)


def _clean(exprs: dict[str, str], digits: int = 4) -> str:
    return ", ".join(rd(zero(e), n, digits) for n, e in exprs.items())


_TREND = {
    "alpha009_3_new": "case when coalesce(lo15 > 0, false) or coalesce(hi15 < 0, false) then d3 else -d3 end",
    "alpha010_3_new": "case when coalesce(lo12 > 0, false) or coalesce(hi12 < 0, false) then d3 else -d3 end",
    "alpha012_3_new": "sign(dv3) * -d3",
    "alpha013_3_new": "avg21 / 7 * 3 - close",
    "alpha021_4_new": "case when avg16 + std16 < avg4 or vol40 / nullif(volume, 0) < 1 then -1.0::double else 1.0::double end",
    "alpha023_2_new": "case when high20 < high then -coalesce(dh2, 0) else 0.0::double end",
    "alpha024_1_new": "case when case when l33 = 0 then rise < 0 else rise / l33 <= 0.05 end then -(close - min33) else -d33 end",
    "alpha046_6_new": "case when bend > 0.25 then -1.0::double when bend < 0 then 1.0::double else -d1 end",
    "alpha049_6_new": "case when bend < -0.1 then 1.0::double else -d1 end",
    "alpha051_6_new": "case when bend < -0.05 then 1.0::double else -d1 end",
    "alpha103_6_new": "p6",
    "alpha104_5_12_new": "case when avg5 > avg12 and avg5p <= avg12p then 1.0::double else 0.0::double end",
    "alpha106_new": "d1 - d1p",
    "alpha107_12_new": "(close - max12) / nullif(max12, 0)",
    "alpha118_6_new": "close - open5",
    "alpha122_6_new": "p6 - pv6",
}


@query(f"""with {BARS},
l1 as (select *, {delta("close", 3)} as d3, {delta("volume", 3)} as dv3, {win("avg", "close", 21)} as avg21,
  {win("avg", "close", 16)} as avg16, {win("stddev_samp", "close", 16)} as std16, {win("avg", "close", 4)} as avg4,
  {win("avg", "volume", 40)} as vol40, {win("avg", "high", 20)} as high20, {delta("high", 2)} as dh2,
  {win("avg", "close", 33)} as avg33, {lag("close", 33)} as l33, {win("min", "close", 33)} as min33, {delta("close", 33)} as d33,
  ({lag("close", 12)} - {lag("close", 6)}) / 10 - ({lag("close", 6)} - close) / 10 as bend, {delta("close", 1)} as d1,
  {pct("close", 6)} as p6, {pct("volume", 6)} as pv6, {win("avg", "close", 5)} as avg5, {win("avg", "close", 12)} as avg12,
  {win("max", "close", 12)} as max12, {lag("open", 5)} as open5 from base),
l2 as (select *, {win("min", "d3", 15)} as lo15, {win("max", "d3", 15)} as hi15, {win("min", "d3", 12)} as lo12,
  {win("max", "d3", 12)} as hi12, {delta("avg33", 33)} as rise, {lag("avg5")} as avg5p, {lag("avg12")} as avg12p, {lag("d1")} as d1p from l1)
select symbol, {TS}, {_clean(_TREND)} from l2""", 4)
def alpha_momentum(spark, d):
    return _alphas(spark, d, {
        "alpha009": [3], "alpha010": [3], "alpha012": [3], "alpha013": [3], "alpha021": [4], "alpha023": [2], "alpha024": [1],
        "alpha046": [6], "alpha049": [6], "alpha051": [6], "alpha103": [6], "alpha104": [[5, 12]], "alpha106": [None],
        "alpha107": [12], "alpha118": [6], "alpha122": [6],
    })


_VOLUME = {
    "alpha006_6_new": f"-{zero('c6')}",
    "alpha014_1_new": "c230",
    "alpha028_5_new": f"{zero('c5')} + (high + low) / 2 - close",
    "alpha110_8_new": "c8",
    "alpha113_6_new": "volume / (vol6 + 1e-9) * coalesce(p1, 0)",
    "alpha115_6_new": "std6",
    "alpha120_6_new": "(volume - vol6) / nullif(vs6, 0)",
    "alpha124_new": "(close - vwap) / nullif(vwap, 0)",
    "alpha126_6_new": "100 - 100 / (1 + up6 / (down6 + 1e-6))",
}


@query(f"""with {BARS},
l1 as (select *, {lag("close", 5)} as l5, {win("avg", "volume", 20)} as vol20, {win2("corr", "open", "volume", 6)} as c6,
  {win2("corr", "close", "volume", 8)} as c8, {win("avg", "volume", 6)} as vol6, {pct("close", 1)} as p1,
  {win("stddev_samp", "(volume * close)", 6)} as std6, {win("stddev_samp", "volume", 6)} as vs6,
  (high + low + close) / 3 as tp from base),
l2 as (select *, {win2("corr", "vwap", "l5", 230)} as c230, {win2("corr", "vol20", "low", 5)} as c5,
  case when tp > {lag("tp")} then tp * volume else 0 end as up, case when tp < {lag("tp")} then tp * volume else 0 end as down from l1),
l3 as (select *, {win("sum", "up", 6)} as up6, {win("sum", "down", 6)} as down6 from l2)
select symbol, {TS}, {_clean(_VOLUME, 4)} from l3""", 4)
def alpha_price_volume(spark, d):
    return _alphas(spark, d, {
        "alpha006": [6], "alpha014": [1], "alpha028": [5], "alpha110": [8], "alpha113": [6], "alpha115": [6], "alpha120": [6],
        "alpha124": [None], "alpha126": [6],
    })


_SHAPE = {
    "alpha041_new": "sqrt(high * low) - vwap",
    "alpha053_4_new": f"-{delta('inner_', 4)}",
    "alpha054_new": "-(low - close) * pow(open, 5) / nullif((case when low - high = 0 then -0.0001::double else low - high end) * pow(close, 5), 0)",
    "alpha101_new": "(close - open) / (high - low + 0.001::double)",
    "alpha116_8_new": "low / nullif(body8, 0) - 1",
    "alpha117_8_new": "((close - h8) - (l8 - close)) / (l8 - h8 + 1e-6)",
    "alpha123_8_new": "(l8 - h8) / nullif(close, 0)",
    "alpha125_8_new": "(l8 - close) / nullif(l8 - h8, 0) * -100",
}


@query(f"""with {BARS},
l1 as (select *, {win("min", "high", 8)} as h8, {win("max", "low", 8)} as l8, {win("min", "least(open, close)", 8)} as body8,
  ((close - low) - (high - close)) / (case when close - low = 0 then 0.0001::double else close - low end) as inner_ from base)
select symbol, {TS}, {_clean(_SHAPE, 3)} from l1""", 3)
def alpha_bar_shape(spark, d):
    return _alphas(spark, d, {
        "alpha041": [None], "alpha053": [4], "alpha054": [None], "alpha101": [None], "alpha116": [8], "alpha117": [8],
        "alpha123": [8], "alpha125": [8],
    })


_RISK = {
    "alpha102_14_new": "up14 / nullif(up14 + down14, 0)",
    "alpha105_12_new": "p12 / nullif(rs12, 0)",
    "alpha108_12_new": "ps12",
    "alpha109_12_new": "case when rs12 > 1e-6 then ra12 / rs12 else 0 end",
    "alpha111_12_new": "case when rv12 <= 1e-14 then 0 else sk12 end",
    "alpha112_20_new": "(close - (m20 - 2 * s20)) / nullif(4 * s20, 0)",
}


@query(f"""with {BARS},
l1 as (select *, {delta("close", 1)} as d1, {pct("close", 1)} as p1, {pct("close", 12)} as p12, {win("stddev_samp", "returns", 12)} as rs12,
  {win("avg", "returns", 12)} as ra12, {win("var_pop", "returns", 12)} as rv12, {win("skewness", "returns", 12)} as sk12,
  {win("avg", "close", 20)} as m20, {win("stddev_samp", "close", 20)} as s20 from base),
l2 as (select *, {win("avg", "(case when d1 > 0 then d1 when d1 <= 0 then 0 end)", 14)} as up14,
  {win("avg", "(case when d1 < 0 then -d1 when d1 >= 0 then 0 end)", 14)} as down14, {win("stddev_samp", "p1", 12)} as ps12 from l1)
select symbol, {TS}, {_clean(_RISK, 4)} from l2""", 4)
def alpha_volatility(spark, d):
    return _alphas(spark, d, {"alpha102": [14], "alpha105": [12], "alpha108": [12], "alpha109": [12], "alpha111": [12], "alpha112": [20]})


_RISK60 = {
    "alpha102_60_new": "up60 / nullif(up60 + down60, 0)",
    "alpha105_60_new": "p60 / nullif(rs60, 0)",
    "alpha109_60_new": "case when rs60 > 1e-6 then ra60 / rs60 else 0 end",
    "alpha111_60_new": "case when rv60 <= 1e-14 then 0 else sk60 end",
    "alpha112_60_new": "(close - (m60 - 2 * s60)) / nullif(4 * s60, 0)",
    "alpha115_60_new": "std60",
    "alpha117_60_new": "((close - h60) - (l60 - close)) / (l60 - h60 + 1e-6)",
    "alpha120_60_new": "(volume - vol60) / nullif(vs60, 0)",
}


@query(f"""with {BARS},
l1 as (select *, {delta("close", 1)} as d1, {pct("close", 60)} as p60, {win("stddev_samp", "returns", 60)} as rs60,
  {win("avg", "returns", 60)} as ra60, {win("var_pop", "returns", 60)} as rv60, {win("skewness", "returns", 60)} as sk60,
  {win("avg", "close", 60)} as m60, {win("stddev_samp", "close", 60)} as s60, {win("stddev_samp", "(volume * close)", 60)} as std60,
  {win("min", "high", 60)} as h60, {win("max", "low", 60)} as l60, {win("avg", "volume", 60)} as vol60, {win("stddev_samp", "volume", 60)} as vs60 from base),
l2 as (select *, {win("avg", "(case when d1 > 0 then d1 when d1 <= 0 then 0 end)", 60)} as up60,
  {win("avg", "(case when d1 < 0 then -d1 when d1 >= 0 then 0 end)", 60)} as down60 from l1)
select symbol, {TS}, {_clean(_RISK60, 3)} from l2""", 3)
def alpha_served_windows(spark, d):
    """Served width 60: kernels instead of frames."""
    return _alphas(spark, d, {
        "alpha102": [60], "alpha105": [60], "alpha109": [60], "alpha111": [60], "alpha112": [60], "alpha115": [60], "alpha117": [60], "alpha120": [60],
    })


_RANKS = {
    "alpha007_12_new": "case when vol12 >= volume then -1 else -rd4 * sign(d4) end",
    "alpha026_2_new": "-mx6",
    "alpha035_8_new": "rv16 * (1 - rs8) * (1 - rr16)",
    "alpha043_2_new": "rb40 * rd16",
    "alpha084_2_new": "pow(ru42, d10 / 1000)",
}


@query(f"""with {BARS},
l1 as (select *, {win("avg", "volume", 12)} as vol12, {delta("close", 4)} as d4, {rank_of_last("volume", 10)} as rv10,
  {rank_of_last("high", 10)} as rh10, {rank_of_last("volume", 16)} as rv16, {rank_of_last("(close + high - low)", 8)} as rs8,
  {rank_of_last("returns", 16)} as rr16, volume / nullif({win("avg", "volume", 40)}, 0) as busy, -{delta("close", 14)} as nd14,
  vwap - {win("max", "vwap", 30)} as under, {delta("close", 10)} as d10, abs({delta("close", 4)}) as ad4 from base),
l2 as (select *, {zero(win2("corr", "rv10", "rh10", 10))} as c10, {rank_of_last("ad4", 12)} as rd4, {rank_of_last("busy", 40)} as rb40,
  {rank_of_last("nd14", 16)} as rd16, {rank_of_last("under", 42)} as ru42 from l1),
l3 as (select *, {win("max", "c10", 6)} as mx6 from l2)
select symbol, {TS}, {_clean(_RANKS)} from l3""", 4)
def alpha_ranks(spark, d):
    return _alphas(spark, d, {"alpha007": [12], "alpha026": [2], "alpha035": [8], "alpha043": [2], "alpha084": [2]})


@query(f"""with {BARS},
s as (select *, sign(returns) as dir, row_number() over (partition by symbol order by timestamp) as rn from base),
c as (select *, case when dir is distinct from lag(dir) over (partition by symbol order by timestamp) then 1 else 0 end as ch from s),
g as (select *, sum(ch) over (partition by symbol order by timestamp rows unbounded preceding) as grp from c)
select symbol, {TS}, row_number() over (partition by symbol, grp order by timestamp) * dir + 0.0::double as alpha119_new,
{rd("sum(case when returns > 0 then volume else -volume end) over (partition by symbol order by timestamp rows unbounded preceding)", "alpha121_new")} from g""")
def alpha_streak_obv(spark, d):
    """119 and 121 across several chunks per symbol, carried by one row per chunk."""
    config = {"alpha119": [None], "alpha121": [None]}
    out = alphas.compute(views.bars(spark, d), config, Chunking(rows=200, micro_seconds=86_400 * 2))
    return seconds(out.select("symbol", "timestamp", "alpha119_new", "alpha121_new"))


# magnitudes of a 16-row window, bin by bin
_W = 16
_POWER = ", ".join(
    f"sqrt(power(list_sum(list_transform(range({_W}), lambda i: c[i + 1] * cos(2 * pi() * {k} * i / {_W}))), 2) + "
    f"power(list_sum(list_transform(range({_W}), lambda i: c[i + 1] * sin(2 * pi() * {k} * i / {_W}))), 2)) as p{k}"
    for k in range(_W // 2)
)
_BINS = range(_W // 2)
_TOTAL = " + ".join(f"p{k}" for k in _BINS)
_PEAK = f"greatest({', '.join(f'p{k}' for k in _BINS if k)})"
_SLOPE = " + ".join(f"(ln({k} / {_W}.0::double) - mu) * ln(case when p{k} = 0 then 1e-10 else p{k} end)" for k in _BINS if k)
_SXX = " + ".join(f"power(ln({k} / {_W}.0::double) - mu, 2)" for k in _BINS if k)
_MU = "(" + " + ".join(f"ln({k} / {_W}.0::double)" for k in _BINS if k) + f") / {_W // 2 - 1}"
_ENTROPY = " + ".join(f"greatest(p{k} / ({_TOTAL}), 1e-12) * ln(greatest(p{k} / ({_TOTAL}), 1e-12))" for k in _BINS)
_SPECTRAL = {
    "alpha127_16_new": "case " + " ".join(f"when p{k} = {_PEAK} then {k} / {_W}.0::double" for k in _BINS if k) + " end",
    "alpha128_16_new": f"-({_SLOPE}) / ({_SXX})",
    "alpha129_16_02_new": f"({' + '.join(f'p{k}' for k in _BINS if k / _W > 0.2)}) / nullif({_TOTAL}, 0)",
    "alpha130_16_new": f"-({_ENTROPY}) / ln({_W // 2})",
}


@query(f"""with {BARS},
w as (select symbol, timestamp, list(close) over (partition by symbol order by timestamp rows between {_W - 1} preceding and current row) as c from bars),
p as (select symbol, timestamp, {_MU} as mu, {_POWER} from w where len(c) = {_W}),
o as (select symbol, timestamp, {", ".join(f'{e} as "{n}"' for n, e in _SPECTRAL.items())} from p)
select symbol, {TS}, {", ".join(rd(zero(f'"{n}"'), n, 4) for n in _SPECTRAL)} from bars left join o using (symbol, timestamp)""", 4)
def alpha_spectral(spark, d):
    """127..130."""
    out = _alphas(spark, d, {"alpha127": [16], "alpha128": [16], "alpha129": [[16, 0.2]], "alpha130": [16]})
    return out.withColumnRenamed("alpha129_16_0.2_new", "alpha129_16_02_new")


def _wavelet_sql(w: int) -> str:
    """The four filter steps spelled out over lists: symmetric extension, convolution, every second value."""
    from tickloom.functions.kernels import DB4_LOW, db4_high

    steps, n, source = [], w, f"select symbol, timestamp, list(close) over (partition by symbol order by timestamp rows between {w - 1} preceding and current row) as a0 from bars"
    steps.append(f"s0 as (select * from ({source}) where len(a0) = {w})")
    for level in range(1, 5):
        out = (n + 7) // 2
        ext = f"list_concat(list_concat(list_reverse(a{level - 1}[1:7]), a{level - 1}), list_reverse(a{level - 1}[{n - 6}:{n}]))"

        def conv(taps):
            terms = " + ".join(f"e[2 * j + 9 - {m}] * {t!r}::double" for m, t in enumerate(taps))
            return f"list_transform(range({out}), lambda j: {terms})"

        steps.append(f"e{level} as (select *, {ext} as e from s{level - 1})")
        keep = "symbol, timestamp" + "".join(f", d{i}" for i in range(1, level))
        steps.append(f"s{level} as (select {keep}, {conv(DB4_LOW)} as a{level}, list_avg({conv(db4_high())}) as d{level} from e{level})")
        n = out
    return ", ".join(steps)


@query(f"""with {BARS}, {_wavelet_sql(24)}
select symbol, {TS}, {rd("coalesce(d4, 0)", "alpha131_24_1_new", 4)}, {rd("coalesce(d3, 0)", "alpha131_24_2_new", 4)}
from bars left join s4 using (symbol, timestamp)""", 4)
def alpha_wavelet(spark, d):
    """131: mean detail coefficients of the two coarsest levels."""
    return _alphas(spark, d, {"alpha131": [[24, 1], [24, 2]]})


# -- vectors --------------------------------------------------------------------------------------

_VCOLS = ["open", "high", "low", "close", "volume", "returns"]


@query(f"""with {BARS}, v as (select symbol, timestamp, [{", ".join(_VCOLS)}] as x from base)
select symbol, {TS}, list_transform(list_concat(list_filter(x, lambda v: abs(v) < 10), list_filter(x, lambda v: not abs(v) < 10))[1:4],
  lambda v: round(v, 6) + 0.0::double) as vector from v""", None)
def vector_trim(spark, d):
    """V-8: too many columns; the tame ones first."""
    base = features.base_columns(views.bars(spark, d))
    vec = F.transform(features.fixed_width(_VCOLS, 4), lambda v: F.round(v, 6) + F.lit(0.0))
    return seconds(base.select("symbol", "timestamp", vec.alias("vector")))


@query("""select vec_id, len(embedding) as n, 111 - len(embedding) as padded, round(list_sum(list_transform(embedding, lambda v: cast(v as double))), 4) + 0.0::double as total,
cast(list_sum(list_transform(embedding, lambda v: case when abs(v) < 10 then 1 else 0 end)) as bigint) as tame from embeddings""", None)
def vector_pad(spark, d):
    """V-8: too few columns; zero-padded to the model width."""
    e = views.table(spark, d, "embeddings")
    wide = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)])
    vec = wide.select("vec_id", features.fixed_width([f"x{i}" for i in range(64)], 111).alias("v"))
    head = F.slice("v", 1, 64)
    return vec.select(
        "vec_id",
        F.size(head).cast("bigint").alias("n"),
        F.size(F.slice("v", 65, 111)).cast("bigint").alias("padded"),
        (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)).alias("total"),
        F.size(F.filter(head, lambda v: F.abs(v) < 10)).cast("bigint").alias("tame"),
    )


_SMALL = {"alpha012": [3], "alpha041": [None], "alpha103": [6], "alpha104": [[5, 12]]}
_FVCOLS = NUMBERS[:6] + ["number_of_trades"] + NUMBERS[6:] + ["vwap", "returns", "alpha012_3_new", "alpha041_new", "alpha103_6_new"]


def _fv_sql() -> str:
    adj = []
    for c in _FVCOLS:
        adj.append(f'"{c}" / coalesce(nullif(stddev_samp(case when b_{c} is null or (b_{c} = 0 and "{c}" = 0) then 0 else "{c}" / nullif(b_{c}, 0) - 1 end) {_VOL.replace("11 preceding", "119 preceding")}, 0), 1) as x_{c}')
    zs = [
        f"coalesce((max(case when rn = 1 then x_{c} end) - avg(case when rn > 1 then x_{c} end)) / nullif(stddev_samp(case when rn > 1 then x_{c} end), 0), 0)"
        for c in _FVCOLS
    ]
    zs.append("max(case when rn = 1 then alpha104_5_12_new end)")
    parts = ", ".join(f"round({z}, 5) + 0.0::double" for z in zs)
    return f"""with {BARS},
l1 as (select *, sign({delta("volume", 3)}) * -{delta("close", 3)} as a012, sqrt(high * low) - vwap as a041, {pct("close", 6)} as a103,
  {win("avg", "close", 5)} as avg5, {win("avg", "close", 12)} as avg12 from base),
l2 as (select * exclude (number_of_trades, vwap), cast(number_of_trades as double) as number_of_trades, {zero("vwap")} as vwap,
  {zero("a012")} as alpha012_3_new, {zero("a041")} as alpha041_new, {zero("a103")} as alpha103_6_new,
  case when avg5 > avg12 and {lag("avg5")} <= {lag("avg12")} then 1.0::double else 0.0::double end as alpha104_5_12_new from l1),
l3 as (select *, {", ".join(f'{lag(c)} as b_{c}' for c in _FVCOLS)} from l2),
l4 as (select symbol, timestamp, alpha104_5_12_new, row_number() over (partition by symbol order by timestamp desc) as rn, {", ".join(adj)} from l3)
select symbol, cast(epoch(max(timestamp)) as bigint) as bar_ts, list_concat([{parts}], [0.0::double, 0.0::double]) as features from l4 group by symbol"""


@query(_fv_sql(), None)
def feature_vectors_small(spark, d):
    """A-4 with a small configuration, checked number by number."""
    out = features.feature_vectors(
        views.bars(spark, d), len(_FVCOLS) + 3, config=_SMALL, exclude=("alpha104_5_12_new",), chunking=HOURS
    )
    vec = F.transform("features", lambda v: F.round(v, 5) + F.lit(0.0)).alias("features")
    return seconds(out.select("symbol", "timestamp", vec))


def _offline_sql() -> str:
    prev = "over (partition by symbol order by timestamp rows between 50000 preceding and 1 preceding)"
    cells = ", ".join(
        f'round(cast(coalesce(("{c}" - avg("{c}") {prev}) / nullif(stddev_samp("{c}") {prev}, 0), 0) as float)::double + 1.3e-7, 3) + 0.0::double'
        for c in [*_FVCOLS, "alpha104_5_12_new"]
    )
    head = _fv_sql().split("l3 as (")[0].rstrip().rstrip(",")
    return f"""{head}, z as (select symbol, timestamp, row_number() over (partition by symbol order by timestamp desc) as rn, [{cells}] as features from l2)
select symbol, {TS}, features from z where rn <= 1440"""


@query(_offline_sql(), None)
def feature_table_offline(spark, d):
    """A-5: offline form, the last 1440 bars per symbol after the plain z-score."""
    out = features.offline_matrix(views.bars(spark, d), _SMALL, 50000, 1440, HOURS)
    vec = F.transform("features", lambda v: F.round(v.cast("double") + 1.3e-7, 3) + F.lit(0.0)).alias("features")
    return seconds(out.select("symbol", "timestamp", vec))


# -- served widths over minute bars ---------------------------------------------------------------

MINUTE_BARS = BARS.replace("date_trunc('hour'", "date_trunc('minute'")
MINUTE_CHUNKS = Chunking(rows=700, micro_seconds=86_400)


def _served_sql(w: int, bars: str = MINUTE_BARS, digits: int = 4) -> str:
    """Every feature that frames can express, at width ``w``."""
    out = {
        "alpha006": f"-{zero('c6')}", "alpha009": "case when coalesce(lo5 > 0, false) or coalesce(hi5 < 0, false) then dw else -dw end",
        "alpha010": "case when coalesce(lo4 > 0, false) or coalesce(hi4 < 0, false) then dw else -dw end", "alpha012": "sign(dvw) * -dw",
        "alpha013": f"avg7 / 7 * {w} - close", "alpha014": "c14", "alpha021": "case when avg4 + std4 < avgw or vol10 / nullif(volume, 0) < 1 then -1.0::double else 1.0::double end",
        "alpha023": "case when high10 < high then -coalesce(dhw, 0) else 0.0::double end",
        "alpha024": "case when case when l33 = 0 then rise < 0 else rise / l33 <= 0.05 end then -(close - min33) else -d33 end",
        "alpha028": f"{zero('c28')} + (high + low) / 2 - close", "alpha046": "case when bend > 0.25 then -1.0::double when bend < 0 then 1.0::double else -d1 end",
        "alpha049": "case when bend < -0.1 then 1.0::double else -d1 end", "alpha051": "case when bend < -0.05 then 1.0::double else -d1 end",
        "alpha053": f"-{delta('inner_', w)}", "alpha102": "up102 / nullif(up102 + down102, 0)", "alpha103": "pw", "alpha105": "pw / nullif(rsw, 0)", "alpha107": "(close - maxw) / nullif(maxw, 0)",
        "alpha108": "psw", "alpha109": "case when rsw > 1e-6 then raw / rsw else 0 end", "alpha110": "c110", "alpha111": "case when rvw <= 1e-14 then 0 else skw end",
        "alpha112": "(close - (avgw - 2 * stdw)) / nullif(4 * stdw, 0)", "alpha113": "volume / (volw + 1e-9) * coalesce(p1, 0)", "alpha115": "stdvc", "alpha116": "low / nullif(bodyw, 0) - 1",
        "alpha117": "((close - hw) - (lw - close)) / (lw - hw + 1e-6)", "alpha118": f"close - {lag('open', w - 1)}", "alpha120": "(volume - volw) / nullif(vsw, 0)", "alpha122": "pw - pvw",
        "alpha123": "(lw - hw) / nullif(close, 0)", "alpha125": "(lw - close) / nullif(lw - hw, 0) * -100", "alpha126": "100 - 100 / (1 + up126 / (down126 + 1e-6))",
    }
    return f"""with {bars},
l1 as (select *, {delta("close", w)} as dw, {delta("volume", w)} as dvw, {delta("high", w)} as dhw, {delta("close", 1)} as d1, {delta("close", 33)} as d33,
  {pct("close", w)} as pw, {pct("volume", w)} as pvw, {pct("close", 1)} as p1, {lag("close", 5 * w)} as l5, {lag("close", 33 * w)} as l33,
  ({lag("close", 2 * w)} - {lag("close", w)}) / 10 - ({lag("close", w)} - close) / 10 as bend,
  {win("avg", "close", w)} as avgw, {win("avg", "close", 4 * w)} as avg4, {win("avg", "close", 7 * w)} as avg7, {win("avg", "close", 33 * w)} as avg33,
  {win("stddev_samp", "close", w)} as stdw, {win("stddev_samp", "close", 4 * w)} as std4, {win("avg", "volume", w)} as volw, {win("avg", "volume", 4 * w)} as vol4,
  {win("avg", "volume", 10 * w)} as vol10, {win("stddev_samp", "volume", w)} as vsw, {win("stddev_samp", "(volume * close)", w)} as stdvc, {win("avg", "high", 10 * w)} as high10,
  {win("min", "close", 33 * w)} as min33, {win("max", "close", w)} as maxw, {win("min", "high", w)} as hw, {win("max", "low", w)} as lw, {win("min", "least(open, close)", w)} as bodyw,
  {win2("corr", "open", "volume", w)} as c6, {win2("corr", "close", "volume", w)} as c110, {win("stddev_samp", "returns", w)} as rsw, {win("avg", "returns", w)} as raw,
  {win("var_pop", "returns", w)} as rvw, {win("skewness", "returns", w)} as skw, (high + low + close) / 3 as tp,
  ((close - low) - (high - close)) / (case when close - low = 0 then 0.0001::double else close - low end) as inner_ from base),
l2 as (select *, {win("min", "dw", 5 * w)} as lo5, {win("max", "dw", 5 * w)} as hi5, {win("min", "dw", 4 * w)} as lo4, {win("max", "dw", 4 * w)} as hi4, {delta("avg33", 33 * w)} as rise,
  {win2("corr", "vwap", "l5", 230 * w)} as c14, {win2("corr", "vol4", "low", w)} as c28, {win("stddev_samp", "p1", w)} as psw,
  {win("avg", "greatest(d1, 0 * d1)", w)} as up102, {win("avg", "greatest(-d1, 0 * d1)", w)} as down102,
  case when tp > {lag("tp")} then tp * volume else 0 end as up, case when tp < {lag("tp")} then tp * volume else 0 end as down from l1),
l3 as (select *, {win("sum", "up", w)} as up126, {win("sum", "down", w)} as down126 from l2)
select symbol, {TS}, {_clean({f"{n}_{w}_new": e for n, e in out.items()}, digits)} from l3"""


_SERVED = [6, 9, 10, 12, 13, 14, 21, 23, 24, 28, 46, 49, 51, 53, 102, 103, 105, 107, 108, 109, 110, 111, 112, 113, 115, 116, 117, 118, 120, 122, 123, 125, 126]


def _served(spark, d, config):
    out = alphas.compute(views.bars(spark, d, "minute"), config, MINUTE_CHUNKS)
    names = [c for c, _, _ in alphas.tasks(config)]
    return seconds(features.zero_missing_columns(out.select("symbol", "timestamp", *[f"`{n}`" for n in names])))


@query(_served_sql(60), 4)
def served_60(spark, d):
    """The frame features at 60 rows over minute bars, several chunks a symbol."""
    return _served(spark, d, {f"alpha{n:03d}": [60] for n in _SERVED})


@query(_served_sql(240), 4)
def served_240(spark, d):
    """The same at 240 rows."""
    return _served(spark, d, {f"alpha{n:03d}": [240] for n in _SERVED})


def _served_ranks_sql(w: int, bars: str = MINUTE_BARS, digits: int = 4) -> str:
    """The features that rank inside the window, at width ``w``, and the crossing of two means."""
    out = {
        f"alpha007_{w}_new": "case when volw >= volume then -1 else -rd * sign(d3) end",
        f"alpha026_{w}_new": "-together",
        f"alpha035_{w}_new": "rv2 * (1 - shape) * (1 - rr2)",
        f"alpha043_{w}_new": "rbusy * rfall",
        f"alpha084_{w}_new": "pow(rtop, d5 / 1000)",
        f"alpha104_{w}_{4 * w}_new": f"case when ms > ml and {lag('ms')} <= {lag('ml')} then 1.0::double else 0.0::double end",
    }
    return f"""with {bars},
l1 as (select *, {win("avg", "volume", w)} as volw, {delta("close", w // 3)} as d3, abs({delta("close", w // 3)}) as ad3, {rank_of_last("volume", 5 * w)} as rv5,
  {rank_of_last("high", 5 * w)} as rh5, {rank_of_last("volume", 2 * w)} as rv2, {rank_of_last("(close + high - low)", w)} as shape, {rank_of_last("returns", 2 * w)} as rr2,
  volume / nullif({win("avg", "volume", 20 * w)}, 0) as busy, -{delta("close", 7 * w)} as fall, vwap - {win("max", "vwap", 15 * w)} as under, {delta("close", 5 * w)} as d5,
  {win("avg", "close", w)} as ms, {win("avg", "close", 4 * w)} as ml from base),
l2 as (select *, {rank_of_last("ad3", w)} as rd, {zero(win2("corr", "rv5", "rh5", 5 * w))} as c5, {rank_of_last("busy", 20 * w)} as rbusy,
  {rank_of_last("fall", 8 * w)} as rfall, {rank_of_last("under", 21 * w)} as rtop from l1),
l3 as (select *, {win("max", "c5", 3 * w)} as together from l2)
select symbol, {TS}, {_clean(out, digits)} from l3"""


def _served_ranks(spark, d, w):
    one = [f"alpha{n:03d}" for n in (7, 26, 35, 43, 84)]
    return _served(spark, d, {n: [w] for n in one} | {"alpha104": [[w, 4 * w]]})


@query(_served_ranks_sql(60), 4)
def served_ranks_60(spark, d):
    """007, 026, 035, 043, 084 and 104 at 60 rows over minute bars."""
    return _served_ranks(spark, d, 60)


@query(_served_ranks_sql(240), 4)
def served_ranks_240(spark, d):
    """The same at 240 rows."""
    return _served_ranks(spark, d, 240)


def _served_spectrum_sql(w: int, high: float, bars: str = MINUTE_BARS, digits: int = 4) -> str:
    """127..131 at width ``w``: each frequency is two dot products of the window with a table of cosines and sines."""
    half = w // 2
    u = f"list_transform(range(1, {half}), lambda k: ln(k / {w}.0::double))"
    logs = "list_transform(p[2:], lambda v: ln(case when v = 0 then 1e-10 else v end))"
    share = "list_transform(p, lambda v: greatest(v / total, 1e-12) * ln(greatest(v / total, 1e-12)))"
    over = f"list_sum(list_transform(range({half}), lambda k: case when k / {w}.0::double > {high!r}::double then p[k + 1] else 0 end))"
    out = {
        f"alpha127_{w}_new": f"list_position(p[2:], list_max(p[2:])) / {w}.0::double", f"alpha128_{w}_new": f"-list_dot_product({logs}, cu) / list_dot_product(cu, cu)",
        f"alpha129_{w}_new": f"{over} / nullif(total, 0)", f"alpha130_{w}_new": f"-list_sum({share}) / ln({half})",
    }
    waves = {f"alpha131_{w}_1_new": "d4", f"alpha131_{w}_2_new": "d3"}
    return f"""with {bars},
turn as (select k, list_transform(range({w}), lambda i: cos(2 * pi() * k * i / {w})) as re, list_transform(range({w}), lambda i: sin(2 * pi() * k * i / {w})) as im from range({half}) t(k)),
c as (select symbol, timestamp, list(close) over (partition by symbol order by timestamp rows between {w - 1} preceding and current row) as c from bars),
q as (select symbol, timestamp, list(sqrt(power(list_dot_product(c, re), 2) + power(list_dot_product(c, im), 2)) order by k) as p from c, turn where len(c) = {w} group by 1, 2),
m as (select *, list_sum(p) as total, list_transform({u}, lambda v: v - list_avg({u})) as cu from q),
o as (select symbol, timestamp, {", ".join(f'{e} as "{n}"' for n, e in out.items())} from m),
{_wavelet_sql(w)}
select symbol, {TS}, {", ".join(rd(zero(f'"{n}"'), n, digits) for n in out)}, {", ".join(rd(f"coalesce({e}, 0)", n, digits) for n, e in waves.items())}
from bars left join o using (symbol, timestamp) left join s4 using (symbol, timestamp)"""


def _served_spectrum(spark, d, w, high):
    out = _served(spark, d, {"alpha127": [w], "alpha128": [w], "alpha129": [[w, high]], "alpha130": [w], "alpha131": [[w, 1], [w, 2]]})
    return out.withColumnRenamed(f"alpha129_{w}_{high}_new", f"alpha129_{w}_new")


@query(_served_spectrum_sql(60, 0.00556), 4)
def served_spectrum_60(spark, d):
    """127 to 131 at 60 rows over minute bars."""
    return _served_spectrum(spark, d, 60, 0.00556)


@query(_served_spectrum_sql(240, 0.00333), 4)
def served_spectrum_240(spark, d):
    """The same at 240 rows."""
    return _served_spectrum(spark, d, 240, 0.00333)


@query(f"""with {BARS} select symbol, {TS}, {rd(zero("returns / (volume * close + 1 + 1e-9::double)"), "alpha114_new", 9)} from base""", 9)
def alpha_sized(spark, d):
    """114: return against size, here one more than volume times close."""
    bars = views.bars(spark, d).withColumn("market_cap", F.col("volume") * F.col("close") + 1)
    return seconds(alphas.compute(bars, {"alpha114": [None]}, HOURS).select("symbol", "timestamp", "alpha114_new"))


# -- the served vector: 100 features and 11 columns, number by number -----------------------------


# a bar of one price has a mean price that differs from it by rounding only, and ratios of such differences are noise
MOVING_BARS = BARS.replace("from ticks group by 1, 2),", "from ticks group by 1, 2 having max(value) > min(value)),")
assert MOVING_BARS != BARS


def _odd_features_sql() -> str:
    """The served features whose widths are no pair of 60 and 240, or that have none."""
    out = {f"alpha013_{w}_new": f"avg{w} / 7 * {w} - close" for w in (30, 40, 60)}
    out |= {f"alpha014_{w}_new": f"far{w}" for w in (30, 40, 60)}
    out |= {n: _SHAPE[n] for n in ("alpha041_new", "alpha054_new", "alpha101_new")}
    out |= {f"alpha104_{a}_{b}_new": f"case when m{a} > m{b} and {lag(f'm{a}')} <= {lag(f'm{b}')} then 1.0::double else 0.0::double end" for a, b in ((60, 240), (240, 720))}
    out |= {"alpha106_new": f"d1 - {lag('d1')}", "alpha124_new": "(close - vwap) / vwap"}
    out |= {f"alpha112_{w}_new": f"(close - (m{w} - 2 * s{w})) / nullif(4 * s{w}, 0)" for w in (20, 60, 240)}
    out |= {"alpha119_new": "row_number() over (partition by symbol, grp order by timestamp) * dir", "alpha121_new": "sum(case when returns > 0 then volume else -volume end) over (partition by symbol order by timestamp rows unbounded preceding)"}
    far = ", ".join(f"{lag('close', 5 * w)} as back{w}, {win('avg', 'close', 7 * w)} as avg{w}" for w in (30, 40, 60))
    means = ", ".join(f"{win('avg', 'close', w)} as m{w}, {win('stddev_samp', 'close', w)} as s{w}" for w in (20, 60, 240, 720))
    return f"""with {MOVING_BARS},
l0 as (select *, sign(returns) as dir, {delta("close", 1)} as d1, {far}, {means} from base),
l1 as (select *, case when dir is distinct from {lag("dir")} then 1 else 0 end as ch, {", ".join(f"{win2('corr', 'vwap', f'back{w}', 230 * w)} as far{w}" for w in (30, 40, 60))} from l0),
l2 as (select *, sum(ch) over (partition by symbol order by timestamp rows unbounded preceding) as grp from l1)
select symbol, {TS}, {_clean(out, 12)} from l2"""


def _vector_sql() -> str:
    names = [c for c, _, _ in alphas.tasks(alphas.DEFAULT_CONFIG)]
    parts = [_odd_features_sql()]
    for w, high in ((60, 0.00556), (240, 0.00333)):
        parts += [_served_sql(w, MOVING_BARS, 12), _served_ranks_sql(w, MOVING_BARS, 12), _served_spectrum_sql(w, high, MOVING_BARS, 12)]
    columns = [*_FVCOLS[:11], *names]
    of = {c: c if i < 11 else f'"{c}"' for i, c in enumerate(columns)} | {f"alpha129_{w}_{h}_new": f'"alpha129_{w}_new"' for w, h in ((60, 0.00556), (240, 0.00333))}
    # a feature that two of the parts hold is the same in both: the first one is taken
    tables = ", ".join(f"p{k} as ({sql})" for k, sql in enumerate(parts))
    taken, picks = set(), []
    for k, sql in enumerate(parts):
        held = set(re.findall(r'as "(alpha[^"]+)"', sql.rsplit("\nselect symbol", 1)[1]))
        for c in names:
            q = of[c].strip('"')
            if q in held and c not in taken:
                taken.add(c)
                picks.append(f'p{k}."{q}" as c{columns.index(c)}')
    assert taken == set(names), set(names) - taken
    base = ", ".join(f"{zero(f'cast({c} as double)')} as c{i}" for i, c in enumerate(columns[:11]))
    joined = " ".join(f"join p{k} using (symbol, bar_ts)" for k in range(len(parts)))
    n = range(len(columns))
    before = ", ".join(f"lag(c{i}) over w as b{i}" for i in n)
    moved = ", ".join(f"c{i} / coalesce(nullif(stddev_samp(case when b{i} is null or (b{i} = 0 and c{i} = 0) then 0 else c{i} / nullif(b{i}, 0) - 1 end) over w, 0), 1) as x{i}" for i in n)
    raw = {columns.index(c) for c in features.RANK_COLUMNS}
    z = ", ".join(
        f"round({'max(case when rn = 1 then c%d end)' % i if i in raw else f'coalesce((max(case when rn = 1 then x{i} end) - avg(case when rn > 1 then x{i} end)) / nullif(stddev_samp(case when rn > 1 then x{i} end), 0), 0)'} + 1.3e-6::double, 3) + 0.0::double" for i in n
    )
    over = "(partition by symbol order by bar_ts rows between 119 preceding and current row)"
    return f"""with {tables},
b as (with {MOVING_BARS} select symbol, {TS}, {base} from base),
f as (select b.*, {", ".join(picks)} from b {joined}),
l as (select *, {before} from f window w as (partition by symbol order by bar_ts)),
v as (select *, row_number() over (partition by symbol order by bar_ts desc) as rn, {moved} from l window w as {over})
select symbol, max(bar_ts) as bar_ts, [{z}] as features from v group by symbol"""


@query()
def feature_vectors(spark, d):
    """A-4: the served job over all bars, 111 numbers per symbol for its newest bar."""
    return seconds(features.feature_vectors(views.bars(spark, d), 111, chunking=HOURS), out="bar_ts")


@query(_vector_sql(), None)
def served_vectors(spark, d):
    """A-2, A-4: the served job checked number by number, over the bars whose price moves."""
    out = features.feature_vectors(views.bars(spark, d).where("high > low"), 111, chunking=HOURS)
    return seconds(out.withColumn("features", F.transform("features", lambda v: F.round(v + F.lit(1.3e-6), 3) + F.lit(0.0))))
