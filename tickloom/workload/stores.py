"""Stored ledgers and the served chain as a job with branches and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import decide, ledger, scoring
from tickloom.plans import steps, views
from tickloom.schemas import ORDERS, SCORES
from tickloom.session import scratch_path
from tickloom.sources import bars as src
from tickloom.sources import ledgers
from tickloom.sources import records as rec
from tickloom.workload.bars import _SMALL
from tickloom.workload.base import BARS, query, rd
from tickloom.workload.judge import _formula_weights
from tickloom.workload.trade import _PLE_DIR, _STATIC, _static, _stop

_EMIT = decide.StrategyConfig(queue_length=50, top_threshold=0.9, bottom_threshold=0.1, min_long_threshold=36.0, min_short_threshold=35.0)


@query(f"""{_STATIC.format(direction=_PLE_DIR)}, {_stop(True)},
told as (select *, coalesce(stop_loss_price is not null and ((direction = 'LONG' and y0_trmt >= 36) or (direction = 'SHORT' and y0_ctrl >= 35)), false) as valid from t4)
select id, case when valid then symbol end as symbol, direction, case when valid then case when id % 3 = 0 and id % 5 = 0 then 'FAILED' when id % 3 = 0 then 'ASSIGNED' else 'NEW' end end as status,
  case when valid and id % 3 = 0 then concat('acct_', id % 4) end as assigned_account, case when valid then case when id % 5 = 0 then 6 else 0 end end::int as retry_count,
  case when valid and id % 15 = 0 then 'Max attempts hit.None' end as failed_reason, {rd("case when valid then stop_loss_price end", "stop_loss", 5)},
  {rd("final_score", digits=5)}, {rd("quantile", digits=5)}, valid as is_valid from told""", 5)
def ledger_rounds(spark, d):
    """D-10 to D-12 stored: two rounds of decisions into order and score ledgers, a compaction between them, then
    assignments, retries and exhausted orders as changes; every write of the second round is replayed with other rows."""
    decided = _static(spark, d, _EMIT, "ple")
    orders, scores = scratch_path(spark, "orders"), scratch_path(spark, "scores")
    for batch in (0, 1):
        part = decided.where(F.col("id") % 2 == batch)
        ledgers.write_orders(spark, orders, part, "decide", batch)
        ledgers.write_scores(spark, scores, part, "decide", batch)
        if batch == 0:
            ledgers.compact(spark, orders, ORDERS)
            ledgers.compact(spark, scores, SCORES)
    again = decided.where("id % 2 = 1").withColumns({"symbol": F.lit("replayed"), "final_score": F.lit(-1.0)})
    ledgers.write_orders(spark, orders, again, "decide", 1)
    ledgers.write_scores(spark, scores, again, "decide", 1)
    now = ledgers.read_ledger(spark, orders, ORDERS).where("id % 3 = 0")
    ledgers.append_changes(spark, orders, now.select("id", F.lit("ASSIGNED").alias("status"), F.concat(F.lit("acct_"), (F.col("id") % 4).cast("string")).alias("assigned_account")), ORDERS, "route", 0)
    now = ledgers.read_ledger(spark, orders, ORDERS)
    ledgers.append_changes(spark, orders, now.where("id % 5 = 0").select("id", (F.col("retry_count") + 6).alias("retry_count")), ORDERS, "settle", 0)
    ledgers.compact(spark, orders, ORDERS)
    out = ledger.exhaust_retries(ledgers.read_ledger(spark, orders, ORDERS)).where("status = 'FAILED'")
    ledgers.append_changes(spark, orders, out.select("id", "status", "failed_reason"), ORDERS, "exhaust", 0)
    have = ledgers.read_ledger(spark, orders, ORDERS).select("id", "symbol", "status", "assigned_account", "retry_count", "failed_reason", "stop_loss")
    told = ledgers.read_ledger(spark, scores, SCORES).select("id", "direction", "final_score", "quantile", "is_valid")
    return told.join(have, "id", "full")


def served_job(paths: dict[str, str], config: dict, **settings) -> dict:
    """Bars to vectors to scores to decisions; bars, records, scores and orders are stored on the way."""
    return {
        "default": "serve",
        "jobs": {
            "serve": {
                "steps": [
                    {"type": "write_bars", "path": paths["bars"], "writer": "serve", "batch": 0},
                    {"type": "offline", "config": config, "as": "vectors"},
                    {"type": "first_inputs", "count": 6},
                    {"type": "score", "weights": paths["weights"], "model": "ple"},
                    {"type": "current_price", "bars": paths["bars"]},
                    {"type": "number"},
                    {"type": "decide", "strategy": "ple", **settings, "as": "decided"},
                    {"type": "write_scores", "from": "decided", "path": paths["scores"], "writer": "serve", "batch": 0},
                    {"type": "write_orders", "from": "decided", "path": paths["orders"], "writer": "serve", "batch": 0},
                    {"type": "write_records", "from": "vectors", "path": paths["records"]},
                ]
            }
        },
    }


_SETTINGS = {"queue_length": 50, "top_threshold": 0.9, "bottom_threshold": 0.1, "min_long_threshold": -100.0, "min_short_threshold": -100.0}


@query(f"""with {BARS},
n as (select symbol, count(*) as n_bars, max_by(close, timestamp) as price, max(timestamp) as newest from bars group by 1)
select symbol, n_bars, least(n_bars, 1440) as n_records, least(n_bars, 1440) as n_scores, greatest(least(n_bars, 1440) - 50, 0) as n_ranked, {rd("price")}, 0::bigint as orders_missing,
  epoch_us(newest) // 1000000 as newest from n""")
def served_chain(spark, d):
    """U-1: the whole served chain from one configuration, run twice (its sinks store a batch once), read back from
    what it stored."""
    paths = {k: scratch_path(spark, f"served-{k}") for k in ("bars", "weights", "scores", "orders")}
    scoring.save_weights(spark, _formula_weights("ple"), paths["weights"])
    bars = views.bars(spark, d).withColumn("interval", F.lit("1h"))
    for again in range(2):
        job = served_job(paths | {"records": scratch_path(spark, "served-records")}, _SMALL, **_SETTINGS)
        steps.run_all(bars, job, steps.REGISTRY)
    stored = src.read_bars(spark, paths["bars"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.max_by("close", "timestamp").alias("price"))
    records = rec.read_records(spark, job["jobs"]["serve"]["steps"][-1]["path"]).groupBy("symbol").agg(F.count_distinct("request_id").alias("n_records"))
    scores = ledgers.read_ledger(spark, paths["scores"], SCORES)
    owner = bars.select("symbol", "timestamp").withColumn("id", F.xxhash64("symbol", "timestamp")).select("id", "symbol", F.unix_timestamp("timestamp").alias("sec"))
    orders = ledgers.read_ledger(spark, paths["orders"], ORDERS).select("id", F.lit(1).alias("ordered"))
    per = scores.join(orders, "id", "left").join(owner, "id").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_scores"), F.count_if(F.col("quantile") != decide.NO_QUANTILE).alias("n_ranked"),
        F.count_if(F.col("is_valid") != F.col("ordered").isNotNull()).alias("orders_missing"), F.max("sec").alias("newest"),
    )
    return stored.join(records, "symbol").join(per, "symbol")
