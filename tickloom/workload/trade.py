"""Decisions, settlement, exits, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.layout import Chunking
from tickloom.functions.numeric import floor_to
from tickloom.operators import decide, ledger, routing, settle
from tickloom.plans import views
from tickloom.sources import bars as src
from tickloom.workload.base import BARS, FILLS, LEDGER, PREDICTIONS, query, rd

# a queue short enough for quantiles to exist in small tables, thresholds that let some rows through
CFG = decide.StrategyConfig(queue_length=50, top_threshold=0.9, bottom_threshold=0.1, min_long_threshold=6.0, min_short_threshold=5.0)
BINS = decide.StrategyConfig(
    queue_length=50, top_threshold=0.9, bottom_threshold=0.1, min_long_threshold=4.0, min_short_threshold=4.0,
    sharpe_bins=(0.0, 0.1, 0.2, 0.4, 0.8), leverage_list=(0, 1, 2, 3, 5),
)
DAYS = Chunking(micro_seconds=86_400)


# -- fills and settlement -------------------------------------------------------------------------


@query(f"""with {FILLS} select order_id, leg, {rd("sum(abs(qty) * price) / sum(abs(qty))", "avg_price", 4)}, {rd("sum(commission)", "commission", 4)}, count(*) as trades
from fills group by 1, 2""", 4)
def fill_price(spark, d):
    """R-24."""
    return ledger.fill_prices(views.fills(spark, d), "order_id", "leg")


@query(f"""with {LEDGER}, {FILLS},
l as (select order_id, sum(abs(qty) * price) filter (leg = 'ENTRY') / sum(abs(qty)) filter (leg = 'ENTRY') as en,
  sum(abs(qty) * price) filter (leg = 'EXIT') / sum(abs(qty)) filter (leg = 'EXIT') as ex, sum(commission) as fee from fills group by 1),
c as (select o.*, l.en, l.ex, l.fee, coalesce(assigned_account in ('acct_0', 'acct_1', 'acct_2'), false) as known, coalesce(en > 0 and ex > 0, false) as good
  from ledger o left join l on o.id = l.order_id where status = 'SETTLED')
select id, case when known and good then 'SETTLED' else 'CLOSED' end as status,
  {rd("case when known and good then en end", "entry_price", 4)}, {rd("case when known and good then ex end", "exit_price", 4)},
  {rd("case when known and good then fee end", "commission", 4)}, cast(case when known and good then 0 else retry_count + 1 end as int) as retry_count,
  case when not known then 'Assigned account not found' when en is null or ex is null then 'Trades not ready or unavailable'
       when not good then 'Invalid price detected' end as failed_reason from c""", 4)
def settlement(spark, d):
    """J-1: both legs, one leg missing, unknown account."""
    o = views.ledger(spark, d)
    none = F.lit(None)
    closed = o.filter("status = 'SETTLED'").withColumns(
        {"status": F.lit("CLOSED"), "entry_price": none.cast("double"), "exit_price": none.cast("double"), "commission": none.cast("double"), "failed_reason": none.cast("string")}
    )
    known = o.filter(F.col("assigned_account").isin("acct_0", "acct_1", "acct_2")).select(F.col("assigned_account").alias("account"))
    out = settle.settle(closed, views.fills(spark, d), known)
    return out.select("id", "status", "entry_price", "exit_price", "commission", "retry_count", "failed_reason")


def _open_orders(spark, d):
    e = views.table(spark, d, "events")
    side = F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT")
    stop = F.when(F.col("event_id") % 7 == 0, 0.0).when(side == "LONG", F.col("value") * 0.4).otherwise(F.col("value") * 1.5 + 1)
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), side.alias("direction"),
        F.unix_timestamp("ts").alias("open_time"), F.when(F.col("event_id") % 11 != 0, stop).alias("stop_loss"),
    )


_OPEN = """
o as (select event_id as id, event_type as symbol, case when event_id % 2 = 0 then 'LONG' else 'SHORT' end as direction, epoch_us(ts) // 1000000 as open_time,
  case when event_id % 11 <> 0 then case when event_id % 7 = 0 then 0.0::double when event_id % 2 = 0 then value * 0.4::double else value * 1.5::double + 1 end end as stop_loss from events)"""
_NOW = 1706572800


@query(f"""with {_OPEN}, t as (select event_type as symbol, epoch_us(ts) // 1000000 as at, value as price from events),
h as (select o.id, min(t.at) as stop_at from o join t on t.symbol = o.symbol and t.at between o.open_time and o.open_time + 3600
  where o.stop_loss <> 0 and ((o.direction = 'LONG' and t.price <= o.stop_loss) or (o.direction = 'SHORT' and t.price >= o.stop_loss)) group by 1),
x as (select o.id, case when open_time + 3600 <= {_NOW} then open_time + 3600 end as timed, case when stop_at <= {_NOW} then stop_at end as stopped from o left join h using (id))
select id, least(timed, stopped) as exit_at, case when stopped is not null and (timed is null or stopped < timed) then 'stop' when timed is not null then 'time' end as exit_reason from x""")
def exit_signals(spark, d):
    """J-5 over price history."""
    ticks = views.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"), F.col("value").alias("close"))
    return settle.first_exit(_open_orders(spark, d), ticks, _NOW).select("id", "exit_at", "exit_reason")


@query(f"""with {BARS}, {_OPEN}, p as (select symbol, max_by(close, timestamp) as mark from bars group by 1),
x as (select *, {_NOW} - open_time >= 3600 as late, coalesce(stop_loss <> 0 and ((direction = 'LONG' and mark <= stop_loss) or (direction = 'SHORT' and mark >= stop_loss)), false) as hit from o left join p using (symbol))
select id, late or hit as should_close, case when late then 'time' when hit then 'stop' end as exit_reason from x""")
def exit_now(spark, d):
    """J-5 against the latest price."""
    prices = src.latest_close(views.bars(spark, d))
    return settle.exit_now(_open_orders(spark, d), prices, _NOW).select("id", "should_close", "exit_reason")


@query(f"""with {BARS}, {PREDICTIONS}, p as (select symbol, max_by(close, timestamp) as mark from bars group by 1)
select id, symbol, {rd("mark", "cur_price")} from predictions left join p using (symbol)""")
def price_attached(spark, d):
    """V-11, J-7."""
    out = src.with_current_price(views.predictions(spark, d), views.bars(spark, d))
    return out.select("id", "symbol", "cur_price")


# -- routing --------------------------------------------------------------------------------------


def _accounts(spark, d):
    """Every customer is an account; some hold a position already."""
    c = views.table(spark, d, "customer")
    held = lambda k, r: F.when(F.col("c_custkey") % k == r, 1.0).otherwise(0.0)
    return c.select(F.concat(F.lit("acct_"), F.col("c_custkey").cast("string")).alias("account"), F.col("c_acctbal").cast("double").alias("available"), held(7, 3).alias("LONG"), held(11, 5).alias("SHORT"))


def _round(spark, d):
    """Orders of a routing round: all new and all active ones, assigned to the customers' accounts."""
    o = views.ledger(spark, d)
    owner = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("acct_"), F.col("o_custkey").cast("string")).alias("_owner"))
    o = o.join(owner, "id").withColumn("assigned_account", F.when(F.col("assigned_account").isNotNull(), F.col("_owner"))).drop("_owner")
    return o.filter(F.col("status").isin("NEW", "ASSIGNED", "OPEN")).withColumn("kelly_rate", (F.col("id") % 9) * 0.1)


_ROUND = f"""with {LEDGER},
acc as (select concat('acct_', cast(c_custkey as varchar)) as account, cast(c_acctbal as double) as available,
  case when c_custkey % 7 = 3 then 1.0::double else 0.0::double end as l, case when c_custkey % 11 = 5 then 1.0::double else 0.0::double end as s from customer),
rnd as (select ledger.* replace ((id % 9) * 0.1::double as kelly_rate, case when assigned_account is not null then concat('acct_', cast(o_custkey as varchar)) end as assigned_account)
  from ledger join orders on o_orderkey = id where status in ('NEW', 'ASSIGNED', 'OPEN')),
busy as (select distinct assigned_account as account, direction from rnd where status in ('ASSIGNED', 'OPEN') and assigned_account is not null),
free as (select a.account, a.available, dir.direction from acc a, (values ('LONG'), ('SHORT')) dir(direction)
  where (case when dir.direction = 'LONG' then a.l else a.s end) = 0 and not exists (select 1 from busy b where b.account = a.account and b.direction = dir.direction)),
asked as (select id, direction, floor(kelly_rate * 300.0::double * 1000) / 1000 as qty, leverage,
  floor(kelly_rate * 300.0::double * 1000) / 1000 * 25.0::double / leverage * 1.05::double as margin from rnd where status = 'NEW')"""


@query(f"{_ROUND} select account, direction, {rd('available')} from free")
def route_eligible(spark, d):
    """J-2, J-3."""
    return settle.eligible_accounts(_accounts(spark, d), _round(spark, d)).select("account", "direction", "available")


@query(f"""{_ROUND} select a.id, a.direction, count(f.account) filter (f.available >= a.margin) as n_accounts,
arg_min(f.account, (f.available, f.account)) filter (f.available >= a.margin) as first_choice from asked a left join free f using (direction) group by 1, 2""")
def route_candidates(spark, d):
    """J-3, J-4 before any order of the round has taken an account."""
    r = _round(spark, d)
    return routing.candidates(r, settle.eligible_accounts(_accounts(spark, d), r), 300.0, 25.0)


@query(f"""with recursive {_ROUND[5:]},
f as (select direction, list(account order by available, account) as accts, list(available order by available, account) as bals from free group by 1),
walk as (
  select direction, accts, bals, -1::bigint as id, null::varchar as account from f
  union all
  select w.direction, list_filter(w.accts, lambda x, i: i <> w.pos), list_filter(w.bals, lambda x, i: i <> w.pos), w.nid, w.accts[w.pos] from (
    select n.*, list_position(list_transform(n.bals, lambda b: b >= n.margin), true) as pos from (
      select w.direction, any_value(w.accts) as accts, any_value(w.bals) as bals, min(a.id) as nid, arg_min(a.margin, a.id) as margin
      from walk w join asked a on a.direction = w.direction and a.id > w.id and a.qty > 0 and a.margin <= w.bals[len(w.bals)] group by w.direction) n) w)
select a.id, a.direction, case when w.account is not null then 'ASSIGNED' else 'FAILED' end as status, w.account as assigned_account,
  {rd("case when w.account is not null then a.qty end", "quantity")},
  case when a.qty <= 0 then 'Calculated order quantity= 0.0 is zero or negative' when w.account is null then 'No elegible account found' end as failed_reason
from asked a left join walk w on w.id = a.id""")
def route(spark, d):
    """J-4: the round itself, accounts taken as it goes."""
    return routing.route(_round(spark, d), _accounts(spark, d), 300.0, 25.0, size=128)


@query(f"with {LEDGER} select id, {rd('floor(quantity * kelly_rate * 7 * 1000) / 1000', 'scaled')} from ledger")
def quantity_scaled(spark, d):
    """V-14."""
    return views.ledger(spark, d).select("id", floor_to(F.col("quantity") * F.col("kelly_rate") * 7).alias("scaled"))


# -- decisions ------------------------------------------------------------------------------------

_DECODED = f"""with {PREDICTIONS},
dec as (select *, least(greatest((exp(trmt_return_1h_out) - 1) / 10, 0), 30) as y0_trmt, least(greatest((exp(ctrl_return_1h_out) - 1) / 10, 0), 30) as y0_ctrl,
  least(greatest((exp(trmt_sigma_1h_out) - 1) / 10, 0), 25) as y1_trmt, least(greatest((exp(ctrl_sigma_1h_out) - 1) / 10, 0), 25) as y1_ctrl,
  exp(t_trmt_out) / (exp(t_trmt_out) + exp(t_ctrl_out)) as t from predictions)"""
_FRAME = "over (partition by symbol order by timestamp, id rows between 50 preceding and 1 preceding)"


def _quantile(score: str) -> str:
    return f"case when len(list({score}) {_FRAME}) = 50 then len(list_filter(list({score}) {_FRAME}, lambda v: v < {score})) / 50.0::double else -999.0::double end"


@query(f"{_DECODED} select id, {rd('y0_trmt')}, {rd('y0_ctrl')}, {rd('y1_trmt')}, {rd('y1_ctrl')}, {rd('t')} from dec")
def decode_outputs(spark, d):
    """D-1, D-2, V-16."""
    return decide.decode(views.predictions(spark, d)).select("id", "y0_trmt", "y0_ctrl", "y1_trmt", "y1_ctrl", "t")


# scores come from a lookup of 1000 values, so ties are real: compare what both engines round alike
_SCORE_SQL = "round((t_trmt_out - t_ctrl_out) * 1000)"


def _scored(spark, d):
    return views.predictions(spark, d).withColumn("final_score", F.round((F.col("t_trmt_out") - F.col("t_ctrl_out")) * 1000))


@query(f"with {PREDICTIONS}, s as (select *, {_SCORE_SQL} as score from predictions) select id, {rd(_quantile('score'), 'quantile')} from s")
def score_quantile(spark, d):
    """D-3 by kernel, several chunks per symbol."""
    cut = Chunking(rows=500, micro_seconds=7200)
    return decide.score_quantile(_scored(spark, d), 50, cut).select("id", "quantile")


_STATIC = f"""with {PREDICTIONS},
dec as (select *, trmt_return_1h_out * 10 as y0_trmt, ctrl_return_1h_out * 10 as y0_ctrl, trmt_sigma_1h_out * 10 as y1_trmt, ctrl_sigma_1h_out * 10 as y1_ctrl,
  {_SCORE_SQL} / 1000 as final_score, t_trmt_out as t from predictions),
q as (select *, {_quantile("final_score")} as quantile from dec),
dir as (select *, {{direction}} as direction from q)"""


def _decoded(spark, d):
    return with_even_scores(views.predictions(spark, d))


def with_even_scores(p):
    """Decoded predictions whose scores both engines round alike."""
    return p.withColumns(
        {
            "y0_trmt": F.col("trmt_return_1h_out") * 10, "y0_ctrl": F.col("ctrl_return_1h_out") * 10,
            "y1_trmt": F.col("trmt_sigma_1h_out") * 10, "y1_ctrl": F.col("ctrl_sigma_1h_out") * 10,
            "t": F.col("t_trmt_out"), "final_score": F.round((F.col("t_trmt_out") - F.col("t_ctrl_out")) * 1000) / 1000,
        }
    )


def _static(spark, d, cfg, strategy):
    q = decide.score_quantile(_decoded(spark, d), cfg.queue_length, DAYS)
    return decide.finish(q.withColumn("direction", decide.static_direction(cfg, strategy)), cfg, strategy)


_PLE_DIR = "case when quantile = -999 then '' when quantile >= 0.9 then 'LONG' when quantile <= 0.1 then 'SHORT' else '' end"
_FIRST_DIR = "case when quantile = -999 then '' when quantile >= 0.9 and final_score > 0 then 'LONG' when quantile <= 0.1 and final_score < 0 then 'SHORT' else '' end"


def _stop(ple: bool) -> str:
    limit = "cur_price + side * step" if ple else "cur_price"
    return f"""t1 as (select *, case direction when 'LONG' then -1.0::double when 'SHORT' then 1.0::double end as side,
  case direction when 'LONG' then cur_price * (1 + y0_trmt / 1000) when 'SHORT' then cur_price * (1 - y0_ctrl / 1000) end as target_price,
  case direction when 'LONG' then y1_trmt when 'SHORT' then y1_ctrl end as sigma from dir),
t2 as (select *, (target_price + cur_price) / 2 * sigma / 1000 as step, (target_price + cur_price) / 2 as mid from t1),
t3 as (select *, mid + side * 3 * step as start, ({limit} - (mid + side * 3 * step)) * side as short_by from t2),
t4 as (select *, start + side * step * case when short_by <= 0 then 0 else ceil(short_by / nullif(step, 0)) end as stop_loss_price from t3)"""


@query(f"""{_STATIC.format(direction=_PLE_DIR)}, {_stop(True)}
select id, direction, {rd("quantile")}, {rd("target_price", digits=5)}, {rd("stop_loss_price", digits=5)}, case when direction <> '' then 1.0::double end as leverage,
  case when stop_loss_price is not null then 0.1::double end as position_ratio,
  coalesce(case when quantile = -999 then '{decide.FAIL_DATA}' when direction = '' then '{decide.FAIL_RANGE}' when stop_loss_price is null then '{decide.FAIL_STOP}'
    when direction = 'LONG' and y0_trmt < 36 then '{decide.FAIL_LONG}' when direction = 'SHORT' and y0_ctrl < 35 then '{decide.FAIL_SHORT}' end, '') as fail_reason from t4""", 5)
def direction_static(spark, d):
    """D-5 mode 1, D-6, D-7, D-8, D-9 of the newer rules."""
    cfg = decide.StrategyConfig(queue_length=50, top_threshold=0.9, bottom_threshold=0.1, min_long_threshold=36.0, min_short_threshold=35.0)
    out = _static(spark, d, cfg, "ple")
    return out.select("id", "direction", "quantile", "target_price", "stop_loss_price", "leverage", "position_ratio", F.coalesce("fail_reason", F.lit("")).alias("fail_reason"))


_LOW_T, _LOW_C = "greatest(y1_trmt - y0_trmt / 2, 0)", "greatest(y1_ctrl - y0_ctrl / 2, 0)"
_WIN = "((target_price - cur_price) * -side - cur_price * 0.001::double)"
_LOSS = "((cur_price - stop_loss_price) * -side + cur_price * 0.001::double)"
_P = "case when direction = 'LONG' then t else 1 - t end"


@query(f"""{_STATIC.format(direction=_FIRST_DIR)}, {_stop(False)},
t5 as (select *, abs(final_score) / case direction when 'LONG' then {_LOW_T} * t + (y1_ctrl + y0_ctrl / 2 - {_LOW_C}) * (1 - t) + 1e-6
    when 'SHORT' then {_LOW_C} * (1 - t) + (y1_trmt + y0_trmt / 2 - {_LOW_T}) * t + 1e-6 end as ratio,
  ({_P} - (1 - ({_P})) / ({_WIN} / {_LOSS} + 1e-6)) * 0.5::double as kelly from t4),
t6 as (select *, case when direction = '' then null when ratio < 0.005 then 0.0::double when ratio < 0.01 then 1.0::double when ratio < 0.02 then 2.0::double when ratio < 0.04 then 3.0::double else 5.0::double end as leverage from t5)
select id, direction, {rd("stop_loss_price", digits=5)}, leverage, {rd("kelly", "position_ratio", 5)},
  coalesce(case when quantile = -999 then '{decide.FAIL_DATA}' when direction = '' then '{decide.FAIL_RANGE}' when stop_loss_price is null then '{decide.FAIL_STOP}'
    when leverage = 0 then '{decide.FAIL_LEVERAGE}' when kelly <= 0 then '{decide.FAIL_KELLY}'
    when direction = 'LONG' and y0_trmt < 36 then '{decide.FAIL_LONG}' when direction = 'SHORT' and y0_ctrl < 35 then '{decide.FAIL_SHORT}' end, '') as fail_reason from t6""", 5)
def half_kelly(spark, d):
    """D-5 mode 1, D-6 bins, D-7, D-8, D-9 of the first rules."""
    cfg = decide.StrategyConfig(
        queue_length=50, top_threshold=0.9, bottom_threshold=0.1, min_long_threshold=36.0, min_short_threshold=35.0,
        sharpe_bins=(0.0, 0.005, 0.01, 0.02, 0.04), leverage_list=(0, 1, 2, 3, 5),
    )
    out = _static(spark, d, cfg, "first")
    return out.select("id", "direction", "stop_loss_price", "leverage", "position_ratio", F.coalesce("fail_reason", F.lit("")).alias("fail_reason"))


@query(f"""with {PREDICTIONS}, v as (select *, case when id % 2 = 0 then 'LONG' else 'SHORT' end as direction, id % 5 <> 0 as is_valid, epoch_us(timestamp) // 1000000 as sec from predictions)
select a.id, count(b.id) filter (b.direction = 'LONG') as recent_long, count(b.id) filter (b.direction = 'SHORT') as recent_short
from v a left join v b on b.symbol = a.symbol and b.is_valid and b.sec between a.sec - 3600 and a.sec and (b.sec < a.sec or b.id < a.id) group by 1""")
def recent_valid(spark, d):
    """D-4."""
    side = F.when(F.col("id") % 2 == 0, "LONG").otherwise("SHORT")
    v = views.predictions(spark, d).withColumns({"direction": side, "is_valid": F.col("id") % 5 != 0})
    return decide.recent_valid(v).select("id", "recent_long", "recent_short")


def _one_way(direction: str, tag: str) -> str:
    """The stop price every row would get if it went this way."""
    text = _stop(True).replace("from dir)", f"from dir{tag})")
    for n in ("t1", "t2", "t3", "t4"):
        text = text.replace(f"{n} as (", f"{tag}{n} as (").replace(f"from {n})", f"from {tag}{n})")
    return f"dir{tag} as (select *, '{direction}' as direction from q), {text}"


_DYNAMIC = f"""{_STATIC.split("dir as (")[0].replace("with ", "with recursive ", 1).replace("{{", "{").replace("}}", "}")}
{_one_way("LONG", "a")}, {_one_way("SHORT", "b")},
rows_ as (select q.*, epoch_us(q.timestamp) // 1000000 as sec, row_number() over (partition by q.symbol order by q.timestamp, q.id) as rn,
  l.stop_loss_price is not null and q.y0_trmt >= {CFG.min_long_threshold} as ok_long, s.stop_loss_price is not null and q.y0_ctrl >= {CFG.min_short_threshold} as ok_short
  from q join at4 l on l.id = q.id join bt4 s on s.id = q.id),
walk as (
  select symbol, 0::bigint as rn, []::struct(d varchar, s bigint)[] as recent, ''::varchar as direction from (select distinct symbol from rows_)
  union all
  select symbol, rn, case when (direction = 'LONG' and ok_long) or (direction = 'SHORT' and ok_short) then list_append(recent, {{'d': direction, 's': sec}}) else recent end, direction from (
    select *, case when quantile = -999 then '' when quantile >= 1.0::double - (1.0::double - {CFG.top_threshold}::double) / ({CFG.k} * n_long + 1) then 'LONG'
        when quantile <= {CFG.bottom_threshold}::double / ({CFG.k} * (len(recent) - n_long) + 1) then 'SHORT' else '' end as direction from (
      select *, len(list_filter(recent, lambda x: x.d = 'LONG')) as n_long from (
        select r.symbol, r.rn, r.sec, r.quantile, r.ok_long, r.ok_short, list_filter(w.recent, lambda x: x.s >= r.sec - {CFG.recent_seconds}) as recent
        from walk w join rows_ r on r.symbol = w.symbol and r.rn = w.rn + 1)))),
dir as (select r.*, w.direction from rows_ r join walk w on w.symbol = r.symbol and w.rn = r.rn),
{_stop(True)},
done as (select *, case when final_score is null then '{decide.FAIL_MISSING}' when quantile = -999 then '{decide.FAIL_DATA}' when direction = '' then '{decide.FAIL_RANGE}' when stop_loss_price is null then '{decide.FAIL_STOP}'
    when direction = 'LONG' and not ok_long then '{decide.FAIL_LONG}' when direction = 'SHORT' and not ok_short then '{decide.FAIL_SHORT}' end as reason from t4)"""


@query(f"""{_DYNAMIC}
select id, symbol, sec as timestamp, {rd("final_score", digits=5)}, {rd("quantile", digits=5)}, direction, case when direction <> '' then {float(CFG.leverage_list[-1])!r}::double end as leverage,
  {rd("cur_price", digits=5)}, {rd("stop_loss_price", digits=5)}, case when stop_loss_price is not null then 0.1::double end as position_ratio, reason is null as is_valid, coalesce(reason, '') as fail_reason from done""", 5)
def direction_dynamic(spark, d):
    """D-5 mode 2, D-10: thresholds that follow the symbol's own recent decisions, as score rows."""
    quantiled = decide.score_quantile(_decoded(spark, d), CFG.queue_length, DAYS)
    return decide.score_rows(decide.dynamic_direction(quantiled, CFG, "ple", DAYS))


@query(f"""{_STATIC.format(direction=_PLE_DIR)}, {_stop(True)}
select id, symbol, direction, 0.1::double as kelly_rate, cast(1 as int) as leverage, {rd("stop_loss_price", "stop_loss", 5)}, 'NEW' as status, epoch_us(timestamp) // 1000000 as created_at
from t4 where stop_loss_price is not null and ((direction = 'LONG' and y0_trmt >= 36) or (direction = 'SHORT' and y0_ctrl >= 35))""", 5)
def emit_orders(spark, d):
    """D-10: the valid rows as new orders."""
    cfg = decide.StrategyConfig(queue_length=50, top_threshold=0.9, bottom_threshold=0.1, min_long_threshold=36.0, min_short_threshold=35.0)
    return decide.new_orders(_static(spark, d, cfg, "ple"))


@query(f"""with {PREDICTIONS} select id, {rd("trmt_return_1h_out", "y0_trmt")}, {rd("ctrl_return_1h_out", "y0_ctrl")}, {rd("trmt_sigma_1h_out", "y1_trmt")},
{rd("ctrl_sigma_1h_out", "y1_ctrl")}, {rd("t_trmt_out", "final_score")} from predictions""")
def decode_raw_heads(spark, d):
    """D-1, the other branch: heads as they come."""
    p = views.predictions(spark, d).withColumn("t_out", F.col("t_trmt_out"))
    return decide.decode(p, "first").select("id", "y0_trmt", "y0_ctrl", "y1_trmt", "y1_ctrl", "final_score")
