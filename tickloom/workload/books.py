"""The order ledger, exchange snapshots and the feature-record store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import ledger
from tickloom.plans import views
from tickloom.session import scratch_path
from tickloom.sources import bars as src
from tickloom.sources import lookups
from tickloom.sources import records as rec
from tickloom.workload.base import BARS, EVALSET, LEDGER, RECORDS, TS, nudge, query, rd, rds, seconds

_ORDER = "id, symbol, direction, quantity, leverage, status, assigned_account, created_at"
_COLS = ["id", "symbol", "direction", "quantity", "leverage", "status", "assigned_account", "created_at"]
_PNL = "(exit_price - entry_price) * quantity"
_PRICED = "entry_price > 0 and exit_price > 0"


def _short(df):
    return df.select(*_COLS)


@query(f"""with {LEDGER},
c as (
  select 'status' as kind, status as name, * from ledger union all select 'direction', direction, * from ledger
  union all select 'symbol', symbol, * from ledger
  union all select 'account', assigned_account, * from ledger where assigned_account is not null
  union all select 'total', '', * from ledger)
select kind, name, count(*) as orders, count(*) filter (status in ('ASSIGNED', 'OPEN')) as active_orders,
  count(*) filter (status = 'CLOSED') as closed_orders, count(*) filter (status = 'FAILED') as failed_orders,
  min(created_at) as first_created, max(created_at) as last_created from c group by 1, 2""")
def order_stats(spark, d):
    """R-1."""
    return ledger.order_stats(views.ledger(spark, d))


@query(f"with {LEDGER} select {_ORDER} from ledger where status = 'OPEN' and symbol = '1-URGENT' order by created_at desc, id desc limit 25")
def orders_latest(spark, d):
    """R-2."""
    return _short(ledger.latest(views.ledger(spark, d), 25, "OPEN", "1-URGENT"))


@query(f"with {LEDGER} select {_ORDER} from ledger where status = 'SETTLED'")
def orders_by_status(spark, d):
    """R-3, V-2."""
    return _short(ledger.by_status(views.ledger(spark, d), "SETTLED"))


@query(f"with {LEDGER} select {_ORDER} from ledger where symbol = '5-LOW'")
def orders_by_symbol(spark, d):
    """R-4."""
    return _short(ledger.by_symbol(views.ledger(spark, d), "5-LOW"))


@query(f"with {LEDGER} select {_ORDER} from ledger where assigned_account = 'acct_2'")
def orders_by_account(spark, d):
    """R-5."""
    return _short(ledger.by_account(views.ledger(spark, d), "acct_2"))


@query(f"with {LEDGER} select {_ORDER} from ledger where id = 7")
def order_by_id(spark, d):
    """R-6."""
    return _short(ledger.by_id(views.ledger(spark, d), 7))


@query(f"""with {LEDGER} select {_ORDER} from ledger
where created_at between epoch(timestamp '1995-03-01')::bigint and epoch(timestamp '1995-04-01')::bigint""")
def orders_by_date(spark, d):
    """R-7: the end day counts through its last second and the first of the next."""
    return _short(ledger.by_date_range(views.ledger(spark, d), "19950301", "19950331"))


@query(f"with {LEDGER} select {_ORDER} from ledger where status in ('ASSIGNED', 'OPEN')")
def orders_active(spark, d):
    """R-8."""
    return _short(ledger.active(views.ledger(spark, d)))


@query(f"with {LEDGER} select {_ORDER} from ledger where status = 'FAILED' order by created_at desc, id desc limit 100")
def orders_failed(spark, d):
    """R-9."""
    return _short(ledger.failed(views.ledger(spark, d)))


@query(f"with {LEDGER} select {_ORDER} from ledger where status = 'NEW'")
def orders_in_status(spark, d):
    """R-14."""
    return _short(ledger.in_status(views.ledger(spark, d), "NEW"))


@query(f"""with {LEDGER} select count(*) as closed_count, {rd("round(avg(commission), 8)", "avg_commission")},
{rd(f"round(sum({_PNL}), 2)", "total_pnl")} from ledger where {_PRICED}""")
def pnl_summary(spark, d):
    """R-10."""
    return ledger.pnl_summary(views.ledger(spark, d))


@query(f"""with {LEDGER} select assigned_account, cast(grouping(assigned_account) as int) as is_total,
{rd(f"sum(case when direction = 'LONG' then {_PNL} else -({_PNL}) end - coalesce(commission, 0))", "pnl", 4)}, count(*) as trades
from ledger where status = 'SETTLED' group by rollup (assigned_account)""", 4)
def pnl_by_account(spark, d):
    """R-11."""
    return ledger.pnl_by_account(views.ledger(spark, d))


@query(f"""with {LEDGER} select assigned_account, count(*) as total_orders, count(*) filter (status in ('ASSIGNED', 'OPEN')) as active_orders,
count(*) filter (status = 'CLOSED') as closed_orders, count(*) filter (status = 'FAILED') as failed_orders,
{rd("round(avg(leverage), 1)", "avg_leverage")}, {rd(f"round(coalesce(sum(case when {_PRICED} then {_PNL} end), 0), 2)", "total_pnl")}
from ledger where assigned_account is not null group by 1""")
def account_stats(spark, d):
    """R-12."""
    return ledger.account_stats(views.ledger(spark, d))


@query(f"""with {LEDGER}, c as (select *, created_at + id % 4000 as close_time from ledger)
select id, assigned_account as account, status, {rd(f"case when direction = 'LONG' then {_PNL} else -({_PNL}) end - commission", "pnl")},
(close_time - created_at) // 60 as hold_minutes from c
where created_at between epoch(timestamp '1994-01-01')::bigint and epoch(timestamp '1996-12-31')::bigint""")
def order_listing(spark, d):
    """R-13."""
    o = views.ledger(spark, d).withColumn("close_time", F.col("created_at") + F.col("id") % 4000)
    out = ledger.listing(o, 757382400, 851990400)
    return out.select("id", "account", "status", "pnl", "hold_minutes")


@query(f"""with {LEDGER}, u as (select id, 'CLOSED' as status, case when id % 2 = 0 then 9 end as retry_count from ledger where id % 3 = 0)
select l.id, coalesce(u.status, l.status) as status, cast(coalesce(u.retry_count, l.retry_count) + case when l.id % 5 = 0 then 1 else 0 end as int) as retry_count
from ledger l left join u using (id)""")
def ledger_updates(spark, d):
    """D-12: fields by id, then one more retry for some."""
    o = views.ledger(spark, d)
    updates = o.filter(F.col("id") % 3 == 0).select("id", F.lit("CLOSED").alias("status"), F.when(F.col("id") % 2 == 0, 9).alias("retry_count"))
    out = ledger.increment_retry(ledger.apply_updates(o, updates), o.filter(F.col("id") % 5 == 0))
    return out.select("id", "status", "retry_count")


@query(f"""with {LEDGER}
select id, case when hit then 'FAILED' else status end as status, case when hit then concat('Max attempts hit.', coalesce(r, 'None')) else r end as failed_reason
from (select *, case when id % 2 = 0 then 'timeout' end as r,
  (status = 'ASSIGNED' and retry_count >= 5) or (status = 'OPEN' and retry_count >= 20) or (status = 'CLOSED' and retry_count >= 5) as hit from ledger)""")
def retry_exhaustion(spark, d):
    """D-11."""
    o = views.ledger(spark, d).withColumn("failed_reason", F.when(F.col("id") % 2 == 0, "timeout"))
    return ledger.exhaust_retries(o).select("id", "status", "failed_reason")


# -- exchange snapshots, derived from the ledger ---------------------------------------------------


def _positions(spark, d):
    o = views.ledger(spark, d).filter("status = 'OPEN'")
    signed = F.when(F.col("direction") == "LONG", F.col("quantity")).otherwise(-F.col("quantity"))
    return o.select(
        F.col("assigned_account").alias("account"), "symbol", F.col("direction").alias("positionSide"), signed.alias("positionAmt"),
        F.col("entry_price").alias("entryPrice"), (F.col("entry_price") * 1.01).alias("markPrice"), F.col("id").alias("seq"),
    )


def _account_trades(spark, d):
    o = views.ledger(spark, d).filter("status = 'SETTLED'")
    return o.select(
        F.col("assigned_account").alias("account"), F.col("direction").alias("positionSide"),
        ledger.directed_pnl().alias("realizedPnl"), "commission",
    )


def _balances(spark, d):
    o = views.ledger(spark, d)
    one = o.filter(F.col("assigned_account").isNotNull()).groupBy(F.col("assigned_account").alias("account"))
    b = one.agg(F.count(F.lit(1)).cast("double").alias("n"))
    kinds = F.array(F.struct(F.lit("USDT").alias("asset"), F.col("n").alias("availableBalance")), F.struct(F.lit("BNB").alias("asset"), F.lit(7.0).alias("availableBalance")))
    return b.select("account", F.inline(kinds))


_SNAP = f"""with {LEDGER},
pos as (select assigned_account as account, direction as side, case when direction = 'LONG' then quantity else -quantity end as amt,
  entry_price as entry, entry_price * 1.01::double as mark, id as seq from ledger where status = 'OPEN'),
trd as (select assigned_account as account, direction as side, case when direction = 'LONG' then {_PNL} else -({_PNL}) end as pnl, commission
  from ledger where status = 'SETTLED'),
bal as (select assigned_account as account, count(*)::double as available from ledger where assigned_account is not null group by 1)"""
_REAL = "coalesce(sum(case when side = '{0}' then pnl - commission end), 0)"
_UNREAL = "coalesce(sum(case when side = '{0}' then (mark - entry) * amt - abs(amt) * mark * 0.0005::double end), 0)"


@query(f"{_SNAP} select account, {rd(_REAL.format('LONG'), 'LONG', 4)}, {rd(_REAL.format('SHORT'), 'SHORT', 4)} from trd group by 1", 4)
def realized_pnl(spark, d):
    """R-26."""
    return ledger.realized_pnl(_account_trades(spark, d))


@query(f"{_SNAP} select account, {rd(_UNREAL.format('LONG'), 'LONG', 4)}, {rd(_UNREAL.format('SHORT'), 'SHORT', 4)} from pos group by 1", 4)
def unrealized_pnl(spark, d):
    """R-27."""
    return ledger.unrealized_pnl(_positions(spark, d))


@query(f"""{_SNAP}, r as (select account, {_REAL.format('LONG')} as l, {_REAL.format('SHORT')} as s from trd group by 1),
u as (select account, {_UNREAL.format('LONG')} as l, {_UNREAL.format('SHORT')} as s from pos group by 1)
select account, {rd("coalesce(r.l, 0) + coalesce(u.l, 0)", "LONG", 4)}, {rd("coalesce(r.s, 0) + coalesce(u.s, 0)", "SHORT", 4)} from r full join u using (account)""", 4)
def total_estimated_pnl(spark, d):
    """R-28."""
    return ledger.total_estimated_pnl(_account_trades(spark, d), _positions(spark, d))


@query(f"""{_SNAP} select account, {rd("coalesce(max_by(amt, seq) filter (side = 'LONG'), 0)", "LONG")}, {rd("coalesce(max_by(amt, seq) filter (side = 'SHORT'), 0)", "SHORT")},
{rd("coalesce(abs(max_by(amt, seq) filter (side = 'SHORT')), 0)", "residual_SHORT")} from pos group by 1""")
def positions_by_side(spark, d):
    """R-29."""
    p = _positions(spark, d)
    rest = ledger.current_position(p, residual=True).select("account", F.col("SHORT").alias("residual_SHORT"))
    return ledger.current_position(p).join(rest, "account")


@query(f"""{_SNAP}, n as (select account, sum(abs(amt) * mark) as notional from pos where amt <> 0 group by 1)
select account, {rd("available")}, {rd("notional", digits=4)}, {rd("available + coalesce(notional, 0)", "total_asset", 4)},
{rd("(available + coalesce(notional, 0)) / 250.0::double", "total_asset_btc", 4)} from bal left join n using (account)""", 4)
def account_assets(spark, d):
    """R-25, R-30, R-31."""
    b, p = _balances(spark, d), _positions(spark, d)
    parts = ledger.available_balance(b).join(ledger.position_notional(p), "account", "left")
    return parts.join(ledger.total_assets(b, p, 250.0), "account")


@query(f"""{_SNAP}, n as (select account, sum(abs(amt) * mark) as notional from pos where amt <> 0 group by 1)
select {rd("sum((available + coalesce(notional, 0)) / 250.0::double)", "total_asset_btc", 3)} from bal left join n using (account)""", 3)
def total_assets_sum(spark, d):
    """R-31 over all accounts."""
    return ledger.total_assets_sum(_balances(spark, d), _positions(spark, d), 250.0)


# -- feature records ------------------------------------------------------------------------------


def _dated(spark, d):
    r = views.records(spark, d)
    return r.withColumn("dt", F.to_date("timestamp")).withColumn("inserted_at", F.col("seq") % 977)


_DATED = f"with {RECORDS}, dated as (select *, cast(timestamp as date) as dt, seq % 977 as inserted_at from records)"
_US = "epoch_us(timestamp) as ts_us"


def _us(df, *columns):
    return df.select(F.unix_micros("timestamp").alias("ts_us"), *columns)


@query(f"""{_DATED}, c as (select 'model' as kind, model_name as name, * from dated union all select 'symbol', symbol, * from dated union all select 'total', '', * from dated)
select kind, name, count(*) as records, epoch_us(min(timestamp)) as first_time, epoch_us(max(timestamp)) as last_time from c group by 1, 2""")
def store_stats(spark, d):
    """R-15."""
    out = rec.store_stats(views.records(spark, d))
    return out.withColumns({c: F.unix_micros(c) for c in ("first_time", "last_time")})


@query(f"""{_DATED} select strftime(dt, '%Y%m%d') as dt, count(*) as total_records, list_sort(list(distinct symbol)) as symbols, list_sort(list(distinct model_name)) as models,
epoch_us(min(timestamp)) as first_time, epoch_us(max(timestamp)) as last_time from dated group by 1""")
def store_day_stats(spark, d):
    """R-16, R-22."""
    out = rec.day_stats(_dated(spark, d))
    return out.withColumns({"dt": F.date_format("dt", "yyyyMMdd"), **{c: F.unix_micros(c) for c in ("first_time", "last_time")}})


@query(f"""{_DATED} select count(*) as total_records, list_sort(list(distinct symbol)) as symbols, list_sort(list(distinct model_name)) as models,
epoch_us(min(timestamp)) as first_time, epoch_us(max(timestamp)) as last_time from dated where dt = date '2024-01-15'""")
def store_one_day(spark, d):
    """R-17."""
    out = rec.one_day(_dated(spark, d), "20240115").drop("dt")
    return out.withColumns({c: F.unix_micros(c) for c in ("first_time", "last_time")})


@query(f"{_DATED} select {_US}, request_id, symbol, model_name from dated order by dt desc, timestamp desc, request_id desc limit 50")
def store_latest(spark, d):
    """R-18."""
    return _us(rec.latest_of_days(_dated(spark, d), 50), "request_id", "symbol", "model_name")


@query(f"{_DATED} select {_US}, request_id, inserted_at from dated order by inserted_at desc, request_id desc limit 50")
def store_latest_inserted(spark, d):
    """R-19."""
    return _us(rec.latest_inserted(_dated(spark, d), 50), "request_id", "inserted_at")


@query(f"""{_DATED} select {_US}, request_id, symbol, 'hdf' as source from dated where request_id = 'req_42'
union all select {_US}, request_id, symbol, 'sql' as source from dated where request_id = 'req_42' and seq % 3 = 0""")
def store_lookup(spark, d):
    """R-20: every store in full."""
    r = _dated(spark, d)
    return _us(rec.by_request_id({"hdf": r, "sql": r.filter(F.col("seq") % 3 == 0)}, "req_42"), "request_id", "symbol", "source")


@query(f"""{_DATED}, u as ((select *, 'hdf' as source from dated order by timestamp desc, request_id desc limit 40)
union all (select *, 'sql' as source from dated where seq % 3 = 0 order by timestamp desc, request_id desc limit 40))
select {_US}, request_id, source from u order by timestamp desc, request_id desc, source limit 40""")
def store_latest_merged(spark, d):
    """R-21."""
    r = _dated(spark, d)
    return _us(rec.latest_merged({"hdf": r, "sql": r.filter(F.col("seq") % 3 == 0)}, 40), "request_id", "source")


@query(f"{_DATED} select {_US}, request_id from dated where symbol = 'click' and model_name = 'ple'")
def store_filter(spark, d):
    """S-19."""
    return _us(rec.select_records(_dated(spark, d), "click", "ple"), "request_id")


@query(f"""with {RECORDS} select symbol, {_US}, {rd("json_extract(ohlcv_data, '$.open')::double", "open")}, 0.0::double as high, 0.0::double as low,
{rd("json_extract(ohlcv_data, '$.close')::double", "close")}, 0.0::double as volume from records where seq % 10 <> 3
union all select symbol, {_US}, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from records where seq % 10 = 3""")
def parse_payloads(spark, d):
    """V-4: objects, lists of klines, broken text (zeros) and a field that is no number (dropped)."""
    r = views.records(spark, d)
    v = F.get_json_object("ohlcv_data", "$.open")
    quote = F.lit('"')
    as_list = F.concat(F.lit('[["0","1","1","1","1","1"],["0",'), quote, v, quote, F.lit(',"0","0",'), quote, v, quote, F.lit(',"0"]]'))
    kind = F.col("seq") % 10
    mixed = r.withColumn("ohlcv_data", F.when(kind == 3, "{broken").when(kind == 5, as_list).otherwise(F.col("ohlcv_data")))
    extra = r.withColumn("ohlcv_data", F.lit('{"open":"n/a","close":1}'))
    out = rec.parse_ohlcv(mixed.unionByName(extra))
    return _us(out, "symbol", "open", "high", "low", "close", "volume")


@query("""with e as (select vec_id, list_transform(embedding, lambda v: v::double) as v from embeddings)
select concat('req_', vec_id) as request_id, 3 as n_bars, 1 as n_rows, 64 as n_columns, list_transform(v[1:5], lambda x: round(x, 5) + 0.0::double) as first_five from e""", None)
def json_payload_summary(spark, d):
    """R-23, S-14."""
    e = views.table(spark, d, "embeddings").select(F.concat(F.lit("req_"), F.col("vec_id")).alias("request_id"), "embedding")
    r = e.select("request_id", F.lit('[["1"],["2"],["3"]]').alias("ohlcv_data"), rec.feature_matrix(e, "embedding").alias("features"))
    s = rec.payload_summary(r)
    five = F.transform("first_five", lambda x: F.round(x.cast("double"), 5) + F.lit(0.0))
    return s.select("request_id", "n_bars", "n_rows", "n_columns", five.alias("first_five"))


@query(f"""with {RECORDS} select count(*) as queued, count(*) filter (seq % 7 <> 0) as written, count(*) filter (seq % 7 = 0) as dropped,
{rd("count(*) filter (seq % 7 <> 0) / count(*)", "success_rate")}, {rd("count(*) filter (seq % 7 = 0) / count(*)", "drop_rate")} from records""")
def write_report(spark, d):
    """V-1, S-21."""
    r = views.records(spark, d).withColumn("request_id", F.when(F.col("seq") % 7 != 0, F.col("request_id")).otherwise(""))
    return rec.write_report(r)


@query(f"""with {RECORDS} select symbol, model_name, count(*) as n, 64 as width from records where seq % 7 <> 0 group by 1, 2""")
def records_written(spark, d):
    """S-12, S-13, S-15: appended by day of writing in two batches, read back."""
    r = views.records(spark, d).withColumn("features", F.array_repeat(F.col("seq").cast("double"), 64)).withColumn("model_output", F.lit(None).cast("string"))
    r = r.withColumn("request_id", F.when(F.col("seq") % 7 != 0, F.col("request_id")).otherwise(""))
    path = scratch_path(spark, "records")
    for part in (r.filter(F.col("seq") % 2 == 0), r.filter(F.col("seq") % 2 == 1)):
        rec.append_records(rec.to_records(part, F.lit("2024-02-01 10:00:00").cast("timestamp")), path)
    back = rec.read_records(spark, path).filter(F.col("dt") == "2024-02-01").filter(F.col("model_output") == "null")
    width = F.size(F.element_at("features", 1))
    return back.groupBy("symbol", "model_name", width.alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_DATED} select count(distinct (symbol, dt)) filter (dt < date '2024-01-11') as removed, count(distinct (symbol, dt)) filter (dt >= date '2024-01-11') as kept,
'2024-01-11' as cutoff from dated""")
def day_retention(spark, d):
    """S-18."""
    return rec.expired_days(_dated(spark, d), "2024-01-31", 20).withColumn("cutoff", F.col("cutoff").cast("string"))


@query(f"""{_DATED} select symbol, strftime(dt, '%Y-%m-%d') as day, count(*) as n from dated where dt >= date '2024-01-11' group by 1, 2""")
def stored_retention(spark, d):
    """S-18, S-8: expired day partitions leave the store, the others stay as they are."""
    path = scratch_path(spark, "retention")
    _dated(spark, d).write.partitionBy("model_name", "dt").parquet(path)
    rec.remove_expired_days(spark, path, "2024-01-31", 20)
    back = spark.read.parquet(path)
    return back.groupBy("symbol", F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_DATED} select strftime(dt, '%Y-%m-%d') as day, count(*) as records, true as has_bytes from dated group by 1""")
def store_day_bytes(spark, d):
    """R-16, R-17, S-9: records beside the files and bytes of every stored day."""
    path = scratch_path(spark, "day-bytes")
    _dated(spark, d).repartition("dt").write.partitionBy("dt").parquet(path)
    counts = spark.read.parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("records"))
    out = counts.join(rec.day_bytes(spark, path), "dt", "left")
    return out.select(F.date_format("dt", "yyyy-MM-dd").alias("day"), "records", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("has_bytes"))


@query(f"""with {EVALSET}, q as (select doc_id as i from evalset)
select vec_id, len(embedding) as n from embeddings where vec_id in (select i from q)""")
def features_by_request(spark, d):
    """S-20: matrices of the wanted requests only."""
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("request_id"), F.array("embedding").alias("features"))
    wanted = views.evalset(spark, d).select(F.col("doc_id").alias("request_id"))
    out = rec.features_of(e, wanted)
    return out.select(F.col("request_id").alias("vec_id"), F.size(F.element_at("features", 1)).cast("bigint").alias("n"))


@query(f"""with {RECORDS} select symbol, count(*) as n, min(dt) as first_day from
(select symbol, strftime(timestamp, '%Y%m%d') as dt from records) group by 1""")
def file_days(spark, d):
    """S-17: the day comes out of a file name."""
    r = views.records(spark, d).withColumn("file", F.concat(F.lit("/x/features_"), F.date_format("timestamp", "yyyyMMdd"), F.lit("_0101_000_AB12.h5")))
    day = F.date_format(rec.date_of_file(F.col("file")), "yyyyMMdd")
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"))


# -- reading little of a stored table -------------------------------------------------------------


def _lookup_store(spark, d, where=None):
    path = scratch_path(spark, "lookup")
    r = _dated(spark, d)
    lookups.write_lookup_store(r if where is None else r.where(where), path)
    return path


@query(f"{_DATED} select {_US}, request_id, symbol, model_name from dated order by dt desc, timestamp desc, request_id desc limit 50")
def stored_latest(spark, d):
    """R-18 from the store: newest day first, no further day read than needed."""
    return _us(lookups.newest_first(spark, _lookup_store(spark, d), 50, day_first=True)[0], "request_id", "symbol", "model_name")


@query(f"{_DATED} select {_US}, request_id, inserted_at from dated order by inserted_at desc, request_id desc limit 50")
def stored_latest_inserted(spark, d):
    """R-19 from the store: days by the greatest insert number in their footers."""
    return _us(lookups.newest_first(spark, _lookup_store(spark, d), 50, "inserted_at")[0], "request_id", "inserted_at")


@query(f"""{_DATED}, u as ((select *, 'hdf' as source from dated order by timestamp desc, request_id desc limit 40)
union all (select *, 'sql' as source from dated where seq % 3 = 0 order by timestamp desc, request_id desc limit 40))
select {_US}, request_id, source from u order by timestamp desc, request_id desc, source limit 40""")
def stored_latest_merged(spark, d):
    """R-21 from two stores."""
    stores = {"hdf": _lookup_store(spark, d), "sql": _lookup_store(spark, d, "seq % 3 = 0")}
    return _us(rec.latest_merged({k: lookups.newest_first(spark, p, 40)[0] for k, p in stores.items()}, 40), "request_id", "source")


@query(f"""{_DATED} select {_US}, request_id, symbol, 'hdf' as source from dated where request_id = 'req_42'
union all select {_US}, request_id, symbol, 'sql' as source from dated where request_id = 'req_42' and seq % 3 = 0""")
def stored_lookup(spark, d):
    """R-20 from two stores: Bloom filters leave out the row groups without the id."""
    stores = {"hdf": _lookup_store(spark, d), "sql": _lookup_store(spark, d, "seq % 3 = 0")}
    return _us(rec.by_request_id({k: spark.read.parquet(p) for k, p in stores.items()}, "req_42"), "request_id", "symbol", "source")


@query(f"""{_DATED} select strftime(dt, '%Y-%m-%d') as day, count(*) as records, min(seq) as first_seq, max(seq) as last_seq, true as is_day from dated group by 1""")
def stored_day_counts(spark, d):
    """R-15 to R-17, R-22: counts and bounds of every stored day from file footers, and the days from their folders."""
    path = _lookup_store(spark, d)
    days = spark.createDataFrame([(x, True) for x in lookups.days_of(spark, path)], "day string, is_day boolean")
    counts = lookups.footer_counts(spark, path, low=("seq",), high=("seq",)).select(F.date_format("dt", "yyyy-MM-dd").alias("day"), F.col("rows").alias("records"), F.col("min_seq").alias("first_seq"), F.col("max_seq").alias("last_seq"))
    return counts.join(days, "day", "full")


@query(f"{_DATED} select strftime(dt, '%Y-%m-%d') as day from dated group by dt")
def store_partitions(spark, d):
    """R-22: the partitions, newest first."""
    return rec.partitions(_dated(spark, d)).select(F.date_format("dt", "yyyy-MM-dd").alias("day"))


def _bar_store(spark, d):
    path = scratch_path(spark, "bar-store")
    src.write_days(views.bars(spark, d).withColumn("interval", F.lit("1h")), path)
    return path


@query(f"""with {BARS} select symbol, count(*) as total_records, epoch_us(min(timestamp)) as earliest_time, epoch_us(max(timestamp)) as latest_time,
{rd("epoch(max(timestamp) - min(timestamp)) / 86400.0::double", "time_span_days", 2)}, true as has_bytes from bars group by 1""")
def stored_cache_stats(spark, d):
    """S-9 from the store: counts from footers, times from two days a symbol, bytes from a listing."""
    path = _bar_store(spark, d)
    size = src.stored_bytes(spark, path).first()
    out = src.stored_stats(spark, path).withColumn("has_bytes", F.lit(size["files"] > 0 and size["bytes"] > 0))
    return out.withColumns({c: F.unix_micros(c) for c in ("earliest_time", "latest_time")} | {"time_span_days": F.round(F.col("time_span_days") + nudge(2), 2)})


@query(f"""with {BARS} select symbol, count(*) as n, epoch_us(min(timestamp)) as first_us from bars where timestamp >= timestamp '2024-01-20 10:30:00' and symbol <> 'click' group by 1""")
def stored_bar_retention(spark, d):
    """S-8 stored: old day folders go, the cut day is rewritten, one symbol is cleared."""
    path = _bar_store(spark, d)
    src.remove_expired(spark, path, "2024-01-30 10:30:00", 10 * 1440)
    src.clear_store(spark, path, "click")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("timestamp")).alias("first_us"))


@query(f"""with {LEDGER}, m as (select id, case when id % 5 = 0 then 'FLAT' when id % 7 = 0 then null else direction end as direction, case when id % 11 = 0 then 'LOST' else status end as status from ledger)
select id, coalesce(direction in ('LONG', 'SHORT') and status in ('NEW', 'ASSIGNED', 'OPEN', 'CLOSED', 'FAILED', 'SETTLED'), false) as valid from m""")
def order_domain(spark, d):
    """V-2: orders whose direction and status are of the allowed values, and the rest."""
    odd = F.when(F.col("id") % 5 == 0, "FLAT").when(F.col("id") % 7 != 0, F.col("direction"))
    good, bad = ledger.valid_domain(views.ledger(spark, d).withColumns({"direction": odd, "status": F.when(F.col("id") % 11 == 0, "LOST").otherwise(F.col("status"))}))
    return good.select("id", F.lit(True).alias("valid")).union(bad.select("id", F.lit(False).alias("valid")))


_NAMES = list(src.INTERVAL_MINUTES)


@query(f"""select event_id, coalesce(map {{{", ".join(f"'{k}': {v}" for k, v in src.INTERVAL_MINUTES.items())}}}[[{", ".join(f"'{k}'" for k in _NAMES)}, 'other'][event_id % {len(_NAMES) + 1} + 1]], 1) as minutes from events""")
def interval_lengths(spark, d):
    """S-6: minutes of an interval name, one for an unknown name."""
    name = F.element_at(F.array(*[F.lit(n) for n in [*_NAMES, "other"]]), (F.col("event_id") % (len(_NAMES) + 1) + 1).cast("int"))
    return views.table(spark, d, "events").select("event_id", src.interval_minutes(name).alias("minutes"))


@query(f"with {BARS} select symbol, {TS}, {rds(['open', 'close', 'volume'])}, number_of_trades from bars")
def bars_scanned(spark, d):
    """S-1: stored bars read back with the explicit schema."""
    return seconds(src.read_bars(spark, _bar_store(spark, d)).select(F.col("symbol").cast("string").alias("symbol"), "timestamp", "open", "close", "volume", "number_of_trades"))


@query("""with t as (select user_id % 50 as request, event_id, value::decimal(12,2)::varchar as v from events),
g as (select request, count(*) as n, min_by(v, event_id) as a, max_by(v, event_id) as z from t group by 1)
select concat('req_', request) as request_id, cast(n as int) as n_bars, concat('["', a, '","1"]') as first_bar, concat('["', z, '","1"]') as last_bar from g""", None)
def json_payload_bars(spark, d):
    """R-23: payloads of different lengths, their first and last bar."""
    e = views.table(spark, d, "events").select((F.col("user_id") % 50).alias("request"), "event_id", F.col("value").cast("decimal(12,2)").cast("string").alias("v"))
    bars = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda b: F.array(b["v"], F.lit("1")))
    r = e.groupBy("request").agg(F.to_json(bars).alias("ohlcv_data")).select(F.concat(F.lit("req_"), F.col("request")).alias("request_id"), "ohlcv_data", F.array(F.array(F.lit(1.0))).alias("features"))
    return rec.payload_summary(r).select("request_id", "n_bars", "first_bar", "last_bar")
