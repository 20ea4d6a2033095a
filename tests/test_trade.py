"""Decisions, routing, settlement and evaluation against brute force."""

import bisect
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.layout import Chunking
from tickloom.operators import decide, evaluate, ledger, routing, settle
from tickloom.streaming import decisions

CFG = decide.StrategyConfig(queue_length=40, top_threshold=0.8, bottom_threshold=0.2, min_long_threshold=3.0, min_short_threshold=3.0, k=2.0)


@pytest.fixture(scope="module")
def preds():
    rng = np.random.default_rng(8)
    n = 900
    gaps = np.where(rng.random(n) < 0.02, 9000, rng.integers(0, 300, n))
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps), unit="s")
    return pd.DataFrame(
        {
            "id": np.arange(n), "symbol": np.where(rng.random(n) < 0.7, "AAA", "BBB"), "timestamp": at, "cur_price": 100 + rng.random(n) * 50,
            "t_trmt_out": rng.random(n), "t_ctrl_out": rng.random(n), "trmt_return_1h_out": 3 + rng.random(n),
            "ctrl_return_1h_out": 3 + rng.random(n), "trmt_sigma_1h_out": 1 + rng.random(n), "ctrl_sigma_1h_out": 1 + rng.random(n),
        }
    )


def walk(preds, cfg):
    """The rules, one row after another."""
    out = {}
    for _, g in preds.sort_values(["timestamp", "id"]).groupby("symbol"):
        queue, recent = deque(maxlen=cfg.queue_length), []
        for r in g.itertuples():
            score = np.exp(r.t_trmt_out) / (np.exp(r.t_trmt_out) + np.exp(r.t_ctrl_out))
            q = sum(s < score for s in queue) / cfg.queue_length if len(queue) == cfg.queue_length else -999.0
            sec = int(r.timestamp.timestamp())
            recent = [(d, s) for d, s in recent if s >= sec - 3600]
            top = 1 - (1 - cfg.top_threshold) / (cfg.k * sum(d == "LONG" for d, _ in recent) + 1)
            bottom = cfg.bottom_threshold / (cfg.k * sum(d == "SHORT" for d, _ in recent) + 1)
            direction = "" if q == -999 else "LONG" if q >= top else "SHORT" if q <= bottom else ""
            y0 = {"LONG": r.trmt_return_1h_out, "SHORT": r.ctrl_return_1h_out}.get(direction)
            y0 = None if y0 is None else min(max(np.expm1(y0) / 10, 0), 30)
            ok = direction == "LONG" and y0 >= cfg.min_long_threshold or direction == "SHORT" and y0 >= cfg.min_short_threshold
            if ok:
                recent.append((direction, sec))
            queue.append(score)
            out[r.id] = (round(q, 9), direction, bool(ok))
    return out


def as_dict(df):
    return {r.id: (round(r.quantile, 9), r.direction, r.is_valid) for r in df.collect()}


@pytest.mark.parametrize("rows", [60, 100_000])
def test_dynamic_direction(spark, preds, rows):
    got = as_dict(decide.decide(spark.createDataFrame(preds), "ple", CFG, Chunking(rows, 3600)))
    want = walk(preds, CFG)
    assert sum(v[2] for v in want.values()) > 20
    assert got == want


@pytest.mark.parametrize("context", [0, 3])
def test_dynamic_direction_of_a_dense_run_in_pieces(spark, context):
    """No hour's pause: one run over many pieces, guesses that are wrong at most borders."""
    rng = np.random.default_rng(9)
    n = 1200
    pdf = pd.DataFrame({"id": np.arange(n), "symbol": "AAA", "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(0, 90, n)), unit="s"), "cur_price": 100.0, "t_trmt_out": rng.random(n), "t_ctrl_out": rng.random(n)})
    pdf = pdf.assign(trmt_return_1h_out=3.9 + rng.random(n), ctrl_return_1h_out=3.9 + rng.random(n), trmt_sigma_1h_out=1.5, ctrl_sigma_1h_out=1.5)
    pieces = Chunking(20, 300)
    quantiled = decide.score_quantile(decide.decode(spark.createDataFrame(pdf), "ple"), CFG.queue_length, pieces)
    got = as_dict(decide.dynamic_direction(quantiled, CFG, "ple", pieces, context=context))
    want = walk(pdf, CFG)
    assert sum(v[2] for v in want.values()) > 60
    assert got == want


@pytest.mark.parametrize("frame_rows", [100_000, 50])
def test_stream_equals_batch(spark, preds, tmp_path, frame_rows):
    source = tmp_path / "in"
    ordered = preds.sort_values(["timestamp", "id"])
    for i, part in enumerate(np.array_split(np.arange(len(ordered)), 3)):
        spark.createDataFrame(ordered.iloc[part].sample(frac=1, random_state=1)).coalesce(1).write.mode("append").parquet(str(source / f"p{i}"))
    schema = spark.read.parquet(str(source / "p0")).schema
    stream = spark.readStream.schema(schema).parquet(str(source / "p*"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    q = decisions.start(decisions.decide_stream(stream, CFG, frame_rows=frame_rows), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert as_dict(spark.read.parquet(str(tmp_path / "out"))) == walk(preds, CFG)


def test_stop_loss_closed_form(spark):
    rng = np.random.default_rng(4)
    rows = [
        (i, "LONG" if i % 2 else "SHORT", float(c), float(y0), float(y1))
        for i, (c, y0, y1) in enumerate(zip(100 + rng.random(200) * 10, rng.random(200) * 900, rng.random(200) * 3 + 0.5))
    ]
    df = spark.createDataFrame(rows, "id bigint, direction string, cur_price double, y0 double, y1 double")
    df = df.select("*", *[F.col(a).alias(f"{a}_{b}") for a in ("y0", "y1") for b in ("trmt", "ctrl")])
    for strategy in ("ple", "first"):
        got = {r.id: r.stop_loss_price for r in decide.with_stop(df, CFG, strategy).collect()}
        for i, d, cur, y0, y1 in rows:
            side = -1 if d == "LONG" else 1
            mid = (cur * (1 - side * y0 / 1000) + cur) / 2
            step = mid * y1 / 1000
            stop, limit = mid + side * 3 * step, cur + side * step if strategy == "ple" else cur
            while (stop - limit) * side < -1e-9:
                stop += side * step
            assert abs(got[i] - stop) < 1e-6, (strategy, i)


def test_zero_step_has_no_stop(spark):
    df = spark.createDataFrame([("LONG", 100.0, 50.0, 0.0)], "direction string, cur_price double, y0_trmt double, y1_trmt double")
    df = df.withColumns({"y0_ctrl": F.lit(0.0), "y1_ctrl": F.lit(0.0)})
    assert decide.with_stop(df, CFG, "ple").first().stop_loss_price is None


@pytest.mark.parametrize("how", [{}, {"size": 2, "piece": 7}, {"size": 1, "piece": 1}])
def test_routing_equals_walking_the_orders(spark, how):
    rng = np.random.default_rng(2)
    orders = pd.DataFrame(
        {
            "id": np.arange(400), "direction": rng.choice(["LONG", "SHORT"], 400), "kelly_rate": rng.choice([0.0, 0.01, 0.3, 1.0, 4.0], 400, p=[0.1, 0.1, 0.3, 0.3, 0.2]),
            "leverage": rng.integers(1, 4, 400), "status": "NEW", "assigned_account": None,
        }
    ).astype({"assigned_account": object})
    orders.loc[3, ["status", "assigned_account", "direction"]] = ["OPEN", "a1", "LONG"]
    accounts = [(f"a{i}", float(b), 0.0, 1.0 if i == 4 else 0.0) for i, b in enumerate([500, 90, 2000, 90, 700, 40])]
    df = spark.createDataFrame(orders, "id bigint, direction string, kelly_rate double, leverage int, status string, assigned_account string")
    acc = spark.createDataFrame(accounts, "account string, available double, LONG double, SHORT double")
    got = {r.id: (r.status, r.assigned_account) for r in routing.route(df, acc, 10.0, 100.0, **how).collect()}
    busy, want = {("a1", "LONG")}, {}
    for r in orders[orders.status == "NEW"].sort_values("id").itertuples():
        qty = np.floor(r.kelly_rate * 10.0 * 1000) / 1000
        fit = [
            (b, a) for a, b, lo, sh in accounts
            if qty > 0 and (a, r.direction) not in busy and (lo if r.direction == "LONG" else sh) == 0 and b >= qty * 100.0 / r.leverage * 1.05
        ]
        if fit:
            busy.add((min(fit)[1], r.direction))
            want[r.id] = ("ASSIGNED", min(fit)[1])
        else:
            want[r.id] = ("FAILED", None)
    assert got == want


@pytest.mark.parametrize("kind", ["few orders", "twice the accounts", "one margin", "one balance", "rising margins"])
def test_routing_in_ranges(spark, kind):
    """15,000 accounts in ten ranges, against a walk over all orders with a sorted list."""
    rng = np.random.default_rng(7)
    n, m = 15_000, {"few orders": 3_000, "twice the accounts": 30_000}.get(kind, 16_000)
    balance = np.full(n, 70.0) if kind == "one balance" else rng.gamma(2.0, 50.0, n).round(1)
    margin = {"one margin": np.full(m, 20.0), "rising margins": np.sort(rng.gamma(2.0, 50.0, m))}.get(kind, rng.gamma(2.0, 40.0, m)).round(1)
    accounts = sorted((b, f"a{i}") for i, b in enumerate(balance))
    free, want = list(accounts), {}
    for i, need in enumerate(margin.tolist()):
        at = bisect.bisect_left(free, (need, ""))
        if at < len(free):
            want[i] = free.pop(at)[1]
    eligible = spark.createDataFrame([("LONG", a, float(b)) for b, a in accounts], "direction string, account string, available double")
    posed = spark.createDataFrame([(i, "LONG", float(x)) for i, x in enumerate(margin)], "id bigint, direction string, _margin double")
    ladder = routing._ranges(eligible, 1500)
    assert ladder.select("range").distinct().count() == 10
    got = {r.id: r._account for r in routing.assignments(posed, eligible, size=1500, piece=2_000).collect()}
    assert got == want


def test_next_free_accounts():
    assert routing.next_free([5.0, 1.0, 5.0, 5.0, 9.0, 0.0], np.array([1.0, 2.0, 5.0, 6.0])) == [2, 0, 3, -1, -1, 1]
    assert routing.next_free([1.0], np.array([])) == [-1]


def test_no_account_at_all(spark):
    df = spark.createDataFrame([(1, "LONG", 0.5, 1, "NEW", None)], "id bigint, direction string, kelly_rate double, leverage int, status string, assigned_account string")
    acc = spark.createDataFrame([], "account string, available double, LONG double, SHORT double")
    row = routing.route(df, acc, 10.0, 100.0).first()
    assert (row.status, row.failed_reason) == ("FAILED", ledger.NO_ACCOUNT_REASON)


@pytest.mark.parametrize("size", [5, 40, 10_000])
@pytest.mark.parametrize("kind", ["smooth", "hot", "binary"])
def test_regression_auc(spark, kind, size):
    rng = np.random.default_rng(5)
    n = 300
    y = rng.normal(size=n).round(2)
    s = (y + rng.normal(size=n)).round(1)
    if kind == "hot":
        y[:120], s[60:180] = 0.5, 0.25
    if kind == "binary":
        y = (y > 0).astype(float)
    good = pairs = 0.0
    for i in range(n):
        for j in range(i + 1, n):
            if y[i] != y[j]:
                pairs += 1
                good += 1 if (y[i] - y[j]) * (s[i] - s[j]) > 0 else 0.5 if s[i] == s[j] else 0
    row = evaluate.regression_auc(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), "y", "s", size).first()
    assert row.pairs == pairs and abs(row.regauc - good / pairs) < 1e-12
    if kind == "binary":
        assert abs(evaluate.auc(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), "y", "s").first().auc - good / pairs) < 1e-12


def test_sampled_regression_auc_is_close(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 5, 400).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": y + rng.normal(size=400)}))
    exact = evaluate.regression_auc(df, "y", "s", 8).first().regauc
    row = evaluate.regression_auc_sampled(df, "y", "s", 4000).first()
    assert row.pairs == 4000 and abs(row.regauc - exact) < 0.03


def test_ledger_argument_checks(spark):
    df = spark.createDataFrame([(1, "NEW", 5)], "id bigint, status string, created_at bigint")
    with pytest.raises(ValueError):
        ledger.by_status(df, "LOST")
    with pytest.raises(ValueError):
        ledger.by_date_range(df, "2024-01-01", "20240102")
    none = df.withColumns({"assigned_account": F.lit("a"), "leverage": F.lit(1), "entry_price": F.lit(1.0), "exit_price": F.lit(1.0), "quantity": F.lit(1.0)})
    with pytest.raises(ValueError):
        ledger.account_stats(none, "missing").collect()


def join_rows(plan):
    """Rows that each join of an executed plan has put out."""
    inner = [n for i in range(plan.children().size()) for n in join_rows(plan.children().apply(i))]
    return inner + ([plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else [])


def test_first_exit_meets_few_rows_an_order_however_dense_the_prices(spark):
    rng = np.random.default_rng(5)
    start, now, n = 1_704_067_200, 1_704_067_200 + 7000, 3000
    whole = lambda k: start + rng.integers(0, 9000, k)
    ticks = [(s, int(t), float(p)) for s, t, p in zip(rng.choice(["A", "B"], n), whole(n), 100 + rng.normal(0, 1, n), strict=True)]
    ticks += [(None, start + 5, 1.0), ("A", None, 1.0), ("A", start + 6, None), ("C", start + 3600, 50.0), ("C", start + 7260, 50.0), ("C", start + 59, 20.0), ("D", start + 9, float("nan"))]
    orders = [(i, str(rng.choice(["A", "B"])), "LONG" if i % 2 else "SHORT", int(t), 100 + (-1 if i % 2 else 1) * float(rng.choice([0.5, 2.5, 3.2, 9.0]))) for i, t in enumerate(whole(n))]
    orders += [
        (n, "C", "LONG", start, 60.0), (n + 1, "C", "LONG", start, 30.0), (n + 2, "C", "LONG", start + 60, 30.0), (n + 3, "C", "LONG", start + 3601, 60.0), (n + 4, "C", "SHORT", start + 3660, 50.0), (n + 5, "C", "LONG", start + 3659, 50.0),
        (n + 6, "A", "LONG", start, None), (n + 7, "A", "LONG", start, 0.0), (n + 8, "A", None, start, 100.0), (n + 9, None, "LONG", start, 100.0), (n + 10, "A", "SHORT", None, 1.0), (None, "A", "SHORT", start, 1.0),
        (n + 11, "A", "LONG", start, 5.0), (n + 11, "B", "LONG", start + 3, 99.0), (n + 12, "A", "LONG", start, float("nan")), (n + 13, "D", "SHORT", start, 9e9), (n + 14, "D", "LONG", start, 9e9),
    ]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan that ran is then the one held by the frame
    try:
        bars = spark.createDataFrame(ticks, "symbol string, at long, close double").select("symbol", F.timestamp_seconds("at").alias("timestamp"), "close")
        out = settle.first_exit(spark.createDataFrame(orders, "id long, symbol string, direction string, open_time long, stop_loss double"), bars, now)
        got = sorted(((r["id"], r["symbol"], r["exit_at"], r["exit_reason"]) for r in out.collect()), key=str)
        joined = join_rows(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

    above = lambda a, b: a != a or (b == b and a >= b)  # NaN is the largest value
    stops = {}
    for i, symbol, direction, opened, stop in orders:
        if None in (i, symbol, direction, opened, stop) or stop == 0:
            continue
        met = [t for s, t, p in ticks if s == symbol and t is not None and p is not None and opened <= t <= opened + 3600 and (above(stop, p) if direction == "LONG" else above(p, stop))]
        if met:
            stops[i] = min(stops.get(i, min(met)), min(met))
    want = []
    for i, symbol, _, opened, _ in orders:
        timed = opened + 3600 if opened is not None and opened + 3600 <= now else None
        stopped = stops[i] if i in stops and stops[i] <= now else None
        reason = "stop" if stopped is not None and (timed is None or stopped < timed) else "time" if timed is not None else None
        want.append((i, symbol, min((x for x in (timed, stopped) if x is not None), default=None), reason))
    assert got == sorted(want, key=str)
    assert {r for *_, r in got} == {"stop", "time", None}
    assert joined and max(joined) <= 2 * len(orders)
