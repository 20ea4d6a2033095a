"""Scoring, evaluation, the daily job, streaming and configured jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tickloom.functions.layout import Chunking
from tickloom.functions.numeric import expm1_label, log1p_label
from tickloom.functions.scalars import training_table
from tickloom.operators import evaluate, scoring
from tickloom.sources import bars as src
from tickloom.sources import commits
from tickloom.plans import daily, steps, views
from tickloom.session import scratch_path
from tickloom.sources import records as rec
from tickloom.streaming import decisions, ingest
from tickloom.workload.base import BARS, EVALSET, RECORDS, TS, query, rd, seconds
from tickloom.workload.trade import _DYNAMIC, CFG, with_even_scores

DAYS = Chunking(micro_seconds=86_400)


# -- scoring --------------------------------------------------------------------------------------


def _vectors(spark, d):
    e = views.table(spark, d, "embeddings")
    wide = F.concat(F.transform("embedding", lambda v: v.cast("double")), F.array_repeat(F.lit(0.0), 47))
    return e.select(F.col("vec_id").alias("id"), wide.alias("features"))


# Both networks at sizes small enough to spell out in SQL: six inputs, experts and trunk of four and three units.


def _small_sizes(model: str) -> dict[str, tuple[int, int]]:
    """Layer name to (outputs, inputs)."""
    if model == "dragonnet":
        return {"trunk.0": (4, 6), "trunk.1": (3, 4)} | {f"{o}.{i}": n for o in scoring.DRAGON_OUTPUTS for i, n in enumerate([(2, 3), (1, 2)])}
    out = {}
    for level, width in ((0, 6), (1, 3)):
        for g in ("shared", "ctrl", "trmt"):
            for e in (0, 1):
                out |= {f"{g}.{level}.{e}.0": (4, width), f"{g}.{level}.{e}.1": (3, 4)}
            out[f"gate.{g}.{level}"] = (6 if g == "shared" else 4, width)
    return out | {f"{o}.{i}": n for o in scoring.PLE_OUTPUTS for i, n in enumerate([(2, 3), (1, 2)])}


def _formula_weights(model: str) -> dict[str, np.ndarray]:
    out = {}
    for c, (name, (rows, columns)) in enumerate(_small_sizes(model).items()):
        i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
        out[f"{name}.weight"], out[f"{name}.bias"] = ((i * 7 + j * 3 + c) % 11 - 5) / 10.0, ((np.arange(rows) + c) % 5 - 2) / 10.0
    return out


def _network_sql(model: str) -> str:
    """The same forward pass as a chain of common table expressions, a column per layer."""
    sizes, names = _small_sizes(model), {n: c for c, n in enumerate(_small_sizes(model))}
    steps: list[tuple[str, str]] = []

    def add(expr: str) -> str:
        steps.append((f"v{len(steps)}", expr))
        return steps[-1][0]

    def linear(x: str, name: str) -> str:
        (rows, columns), c = sizes[name], names[name]
        cells = [" + ".join([f"{x}[{j + 1}] * {((i * 7 + j * 3 + c) % 11 - 5) / 10.0!r}::double" for j in range(columns)] + [f"{((i + c) % 5 - 2) / 10.0!r}::double"]) for i in range(rows)]
        return add(f"[{', '.join(cells)}]")

    def dense(x: str, name: str, last: bool) -> str:
        i = 0
        while f"{name}.{i}" in sizes:
            x = linear(add(f"list_transform({x}, lambda v: greatest(v, 0))") if i else x, f"{name}.{i}")
            i += 1
        return add(f"list_transform({x}, lambda v: greatest(v, 0))") if last else x

    def mix(x: str, name: str, experts: list[str]) -> str:
        e = add(f"list_transform({linear(x, name)}, lambda v: exp(v))")
        return add("[" + ", ".join(f"({' + '.join(f'{e}[{k + 1}] * {w}[{i + 1}]' for k, w in enumerate(experts))}) / list_sum({e})" for i in range(3)) + "]")

    if model == "dragonnet":
        trunk = dense("x", "trunk", True)
        heads = {o: dense(trunk, o, False) for o in scoring.DRAGON_OUTPUTS}
    else:
        at = {"shared": "x", "ctrl": "x", "trmt": "x"}
        for level in (0, 1):
            e = {g: [dense(at[g], f"{g}.{level}.{k}", True) for k in (0, 1)] for g in at}
            seen = {"ctrl": e["ctrl"] + e["shared"], "trmt": e["trmt"] + e["shared"], "shared": e["shared"] + e["ctrl"] + e["trmt"]}
            at = {g: mix(at[g], f"gate.{g}.{level}", seen[g]) for g in at}
        heads = {o: dense(at["trmt" if "trmt" in o else "ctrl"], o, False) for o in scoring.PLE_OUTPUTS}
    chain = "n as (select vec_id as id, list_transform(embedding[1:6], lambda v: v::double * 4) as x from embeddings)"
    last = "n"
    for name, expr in steps:
        chain += f",\nn_{name} as (select *, {expr} as {name} from {last})"
        last = f"n_{name}"
    out = ", ".join(rd(f"1 / (1 + exp(-{v}[1]))" if o in scoring.SIGMOID_OUTPUTS else f"{v}[1]", o) for o, v in heads.items())
    return f"with {chain}\nselect id, {out} from {last}"


def _six(spark, d):
    e = views.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double") * 4).alias("features"))


@query(_network_sql("ple"))
def score_ple(spark, d):
    """M-1, M-2: the layered network."""
    return scoring.score(_six(spark, d), "ple", _formula_weights("ple"))


@query(_network_sql("dragonnet"))
def score_dragonnet(spark, d):
    """M-1, M-2: the shared-trunk network."""
    return scoring.score(_six(spark, d), "dragonnet", _formula_weights("dragonnet"))


def _served_weights(model: str) -> dict[str, np.ndarray]:
    """Full-size layers from a formula that SQL can repeat, scaled so that values keep their size from layer to layer."""
    out = {}
    for c, (name, (rows, columns)) in enumerate(scoring.layer_sizes(model).items()):
        i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
        out[f"{name}.weight"], out[f"{name}.bias"] = ((i * 7 + j * 3 + c) % 11 - 5) / (3.0 * columns**0.5), ((np.arange(rows) + c) % 5 - 2) / 10.0
    return out


def _served_network_sql(model: str) -> str:
    """The served network, 111 inputs: a layer is one list of dot products with rows made by the weight formula."""
    sizes = scoring.layer_sizes(model)
    order, steps = {n: c for c, n in enumerate(sizes)}, ["n as (select vec_id as id, list_concat(list_transform(embedding, lambda v: v::double), list_transform(range(47), lambda i: 0.0::double)) as x from embeddings)"]

    def add(expr: str, more: str = "") -> str:
        name = f"v{len(steps)}"
        steps.append(f"n_{name} as (select p.*, {expr} as {name} from {steps[-1].split(' ')[0]} p{more})")
        return name

    def linear(x: str, name: str) -> str:
        (rows, columns), c = sizes[name], order[name]
        row = f"{{'w': list_transform(range({columns}), lambda j: ((i * 7 + j * 3 + {c}) % 11 - 5) / (3.0::double * sqrt({columns}::double))), 'b': ((i + {c}) % 5 - 2) / 10.0::double}}"
        return add(f"list_transform(l.w, lambda r: list_dot_product(p.{x}, r.w) + r.b)", f", (select list({row} order by i) as w from range({rows}) t(i)) l")

    def dense(x: str, name: str, last: bool) -> str:
        i = 0
        while f"{name}.{i}" in sizes:
            x = linear(add(f"list_transform({x}, lambda v: greatest(v, 0))") if i else x, f"{name}.{i}")
            i += 1
        return add(f"list_transform({x}, lambda v: greatest(v, 0))") if last else x

    def mix(x: str, name: str, experts: list[str]) -> str:
        e = add(f"list_transform({linear(x, name)}, lambda v: exp(v))")
        parts = " + ".join(f"{e}[{k + 1}] * {w}[i + 1]" for k, w in enumerate(experts))
        return add(f"list_transform(range(128), lambda i: ({parts}) / list_sum({e}))")

    if model == "dragonnet":
        trunk = dense("x", "trunk", True)
        heads = {o: dense(trunk, o, False) for o in scoring.DRAGON_OUTPUTS}
    else:
        at = {"shared": "x", "ctrl": "x", "trmt": "x"}
        for level in (0, 1):
            e = {g: [dense(at[g], f"{g}.{level}.{k}", True) for k in (0, 1)] for g in at}
            seen = {"ctrl": e["ctrl"] + e["shared"], "trmt": e["trmt"] + e["shared"], "shared": e["shared"] + e["ctrl"] + e["trmt"]}
            at = {g: mix(at[g], f"gate.{g}.{level}", seen[g]) for g in at}
        heads = {o: dense(at["trmt" if "trmt" in o else "ctrl"], o, False) for o in scoring.PLE_OUTPUTS}
    out = ", ".join(rd(f"1 / (1 + exp(-{v}[1]))" if o in scoring.SIGMOID_OUTPUTS else f"{v}[1]", o) for o, v in heads.items())
    return "with " + ",\n".join(steps) + f"\nselect id, {out} from {steps[-1].split(' ')[0]}"


@query(_served_network_sql("ple"))
def score_served_width(spark, d):
    """M-1 at the served size: 111 inputs, full layers."""
    return scoring.score(_vectors(spark, d), "ple", _served_weights("ple"))


@query(_served_network_sql("dragonnet"))
def score_served_dragonnet(spark, d):
    """M-2 at the served size: 111 inputs, full layers."""
    return scoring.score(_vectors(spark, d), "dragonnet", _served_weights("dragonnet"))


_HIDDEN = ", ".join(
    f"greatest(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::double * sin({j} * 64 + i))) + 0.1::double * {j}, 0)" for j in range(4)
)
_OUT = " + ".join(f"h[{j + 1}] * cos({j})" for j in range(4))


@query(f"""with n as (select vec_id as id, [{_HIDDEN}] as h from embeddings)
select id, {rd(f"1 / (1 + exp(-(({_OUT}) / 10)))", "t_out")} from n""")
def score_dense(spark, d):
    """M-2 layers and sigmoid head on a net small enough to spell out in SQL."""
    w = {
        "net.0.weight": np.sin(np.arange(4)[:, None] * 64 + np.arange(64)[None, :]), "net.0.bias": 0.1 * np.arange(4),
        "net.1.weight": np.cos(np.arange(4))[None, :] / 10, "net.1.bias": np.zeros(1),
    }
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))

    def net(x, weights):
        return [scoring.dense(x, weights, "net", False)[:, 0]]

    return scoring.apply_network(e, net, ["t_out"], w, "features", ("id",))


# -- evaluation -----------------------------------------------------------------------------------


@query(f"""with {EVALSET}, r as (select y_true, rank() over (order by y_pred) + (count(*) over (partition by y_pred) - 1) / 2.0::double as rk from evalset)
select {rd("(sum(rk) filter (y_true = 1) - count(*) filter (y_true = 1) * (count(*) filter (y_true = 1) + 1) / 2.0::double) / (count(*) filter (y_true = 1) * count(*) filter (y_true = 0))", "auc")} from r""")
def auc(spark, d):
    """M-3."""
    return evaluate.auc(views.evalset(spark, d), "y_true", "y_pred")


_PAIRS = """with v as (select o_orderkey as i, o_custkey % 97 as y, round(o_totalprice / 1000) as s from orders),
c as (select y, s, count(*) as n from v group by 1, 2),
p as (select sum(a.n * b.n) filter (a.s < b.s) as good, sum(a.n * b.n) filter (a.s = b.s) as tied, sum(a.n * b.n) as pairs from c a join c b on a.y < b.y)"""


@query(f"{_PAIRS} select {rd('(good + tied / 2.0::double) / pairs', 'regauc')}, cast(pairs as double) as pairs from p")
def regauc_exact(spark, d):
    """M-4 over all orders: every unequal-label pair counted, none produced."""
    o = views.table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("y"), F.round(F.col("o_totalprice") / 1000).alias("s"))
    return evaluate.regression_auc(o, "y", "s")


_U, _V = "((r * 7919 + 17) % 10007) / 10007.0", "((r * 104729 + 31) % 99991) / 99991.0"


@query(f"""with o as (select o_custkey % 97 as y, o_totalprice / 1000 as s from orders),
p as (select y, s, row_number() over (order by y, s) - 1 as pos, count(*) over () as total, count(*) over (partition by y) as ny from o),
b as (select *, min(pos) over (partition by y) as ystart from p),
d as (select {_U}::double as u, {_V}::double as v from range(2000) t(r)),
i as (select b.*, d.v from d join b on b.pos = cast(floor(d.u * b.total) as bigint)),
j as (select *, cast(floor(v * (total - ny)) as bigint) as k from i),
w as (select y, s, case when k < ystart then k else k + ny end as pos2 from j)
select {rd("avg(case when (w.y - b.y) * (w.s - b.s) > 0 then 1.0 when w.s = b.s then 0.5 else 0.0 end)", "regauc")}, count(*) as pairs from w join b on b.pos = w.pos2""")
def regauc_sampled(spark, d):
    """M-4 by drawn pairs, the draws from a formula that SQL can repeat."""
    o = views.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("y"), (F.col("o_totalprice") / 1000).alias("s"))
    draws = spark.range(2000).withColumnRenamed("id", "r").selectExpr(f"CAST({_U.replace('.0', '.0D')} AS DOUBLE) AS u", f"CAST({_V.replace('.0', '.0D')} AS DOUBLE) AS v")
    return evaluate.regression_auc_sampled(o, "y", "s", draws=draws)


_LOSS = f"""with {EVALSET}, m as (select e.*, l.toxic, (y_pred % 200 - 100) / 20 as x, [(y_pred % 7) / 3, (y_pred % 11) / 4] as z from evalset e join labels l using (doc_id)),
s as (select *, ln(exp(z[1]) + exp(z[2])) as lse, (y_pred % 100) / 100 as soft from m),
c as (select *, lse - z[cast(y_true as int) + 1] as ce, list_transform(range(50), lambda i: exp(-abs(soft - i / 49.0::double) / (sqrt(soft) + 1e-6))) as spread from s)"""


def _mm(expr: str, mask: str, name: str) -> str:
    return rd(f"sum(({expr}) * {mask}) / greatest(sum({mask}), 1)", name)


@query(f"""{_LOSS} select {_mm("greatest(x, 0) - x * y_true + ln(1 + exp(-abs(x)))", "(1 - toxic)", "logloss")}, {_mm("0.5::double * power(y_true - x, 2)", "(1 - toxic)", "mse")},
{_mm("ce * [0.7::double, 1.3::double][cast(y_true as int) + 1]", "1", "cross_entropy")},
{_mm("[0.7::double, 1.3::double][cast(y_true as int) + 1] * power(1 - exp(-ce), 2) * case when y_true = 0 then 1.05::double else 1 end * ce", "1", "focal")},
{_mm("-list_sum(list_transform(spread, lambda p, i: p * (case when i % 2 = 1 then z[1] else z[2] end - ln(25 * exp(z[1]) + 25 * exp(z[2])))) ) / list_sum(spread)", "1", "distilled")} from c""")
def masked_losses(spark, d):
    """M-5."""
    e = views.evalset(spark, d).join(views.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    x = (F.col("y_pred") % 200 - 100) / 20
    z = F.array((F.col("y_pred") % 7) / 3, (F.col("y_pred") % 11) / 4)
    soft, y, mask = (F.col("y_pred") % 100) / 100, F.col("y_true"), 1 - F.col("toxic")
    many = F.flatten(F.array_repeat(z, 25))
    return e.agg(
        evaluate.masked_mean(evaluate.logloss(x, y), mask).alias("logloss"),
        evaluate.masked_mean(evaluate.half_square(x, y), mask).alias("mse"),
        evaluate.masked_mean(evaluate.cross_entropy(z, y, [0.7, 1.3])).alias("cross_entropy"),
        evaluate.masked_mean(evaluate.focal(z, y, [0.7, 1.3])).alias("focal"),
        evaluate.masked_mean(evaluate.distilled(many, soft)).alias("distilled"),
    )


@query(f"""with {EVALSET}, m as (select *, ((y_pred % 50) / 60 + 0.01::double) / 1.02::double as p, y_pred / 1000 as y0, y_pred / 900 as y1, (y_pred % 13) / 3 as y from evalset)
select {rd("avg(power(y - (y_true * y1 + (1 - y_true) * y0 + (y_true / p - (1 - y_true) / (1 - p)) * 0.1::double), 2) * 2)", "loss", 4)} from m""", 4)
def targeted_loss(spark, d):
    """M-6."""
    x = F.col("y_pred")
    loss = evaluate.targeted_loss((x % 50) / 60, x / 1000, x / 900, F.col("y_true"), (x % 13) / 3, 0.1, 2.0)
    return views.evalset(spark, d).agg(evaluate.masked_mean(loss).alias("loss"))


@query(f"""with {EVALSET} select cast(y_true as int) as treatment, {rd("avg(y_pred)", "pred_mean")}, {rd("avg(y_pred % 10)", "label_mean")}, count(*) as n from evalset group by 1""")
def means_by_treatment(spark, d):
    """M-7."""
    e = views.evalset(spark, d).select(F.col("y_true").cast("int").alias("treatment"), "y_pred", (F.col("y_pred") % 10).alias("y"))
    return evaluate.means_by_treatment(e, "treatment", "y_pred", "y")


@query(f"""with {BARS} select symbol, {rd("coalesce(vwap, 0)", "vwap")}, {rd("coalesce(returns, 0) * 1000", "amplitude")} from base""")
def training_prep(spark, d):
    """V-15."""
    from tickloom.operators.features import base_columns

    base = base_columns(views.bars(spark, d)).select("symbol", "timestamp", "vwap", F.col("returns").alias("amplitude"))
    return training_table(base)


# -- the daily job --------------------------------------------------------------------------------


def _store(spark, d):
    r = views.records(spark, d)
    r = r.withColumns({"features": F.array(F.col("seq").cast("double")), "model_output": F.lit("{}")})
    path = scratch_path(spark, "store")
    rec.append_records(rec.to_records(r, F.col("timestamp")), path)
    return path


@query(f"""with {RECORDS} select symbol, strftime(timestamp, '%Y-%m-%d') as dt, count(*) as records, count(*) as rows, {rd("count(*) / 70.0::double * 100", "completeness_pct")},
count(*) < 63 as low, 'processed' as status, null::varchar as error from records group by 1, 2""")
def aggregation_report(spark, d):
    """R-32."""
    out = daily.report(views.records(spark, d), 70)
    return out.withColumn("dt", F.date_format("dt", "yyyy-MM-dd"))


_DAY = "over (partition by symbol order by timestamp rows between 20 preceding and 1 preceding)"


@query(f"""with {RECORDS}, v as (select symbol, timestamp, json_extract(ohlcv_data, '$.close')::double as close from records where cast(timestamp as date) = date '2024-01-15')
select symbol, epoch_us(timestamp) as ts_us, {rd("close")}, {rd(f"case when count(close) {_DAY} = 20 then avg(close) {_DAY} end", "close_mean")},
{rd(f"case when count(close) {_DAY} = 20 then stddev_samp(close) {_DAY} end", "close_std")}, 20 as window_rows from v""")
def daily_aggregation(spark, d):
    """ST-2, S-16: one day of the record store, written by symbol and day, run twice, read back."""
    path, out = _store(spark, d), scratch_path(spark, "aggregated")
    for _ in range(2):
        daily.run_day(spark, path, out, "2024-01-15", 20, DAYS)
    back = spark.read.parquet(out)
    return back.select(F.col("symbol").cast("string").alias("symbol"), F.unix_micros("timestamp").alias("ts_us"), "close", "close_mean", "close_std", "window_rows")


@query(f"""with {RECORDS}, r as (select symbol, cast(timestamp as date) as dt, count(*) as records, count(*) filter (symbol <> 'view') as ok from records where symbol in ('click', 'view') group by 1, 2)
select symbol, strftime(dt, '%Y-%m-%d') as dt, records, ok as rows, {rd("ok / 70.0::double * 100", "completeness_pct")}, ok < 63 as low, case when ok = 0 then 'failed' else 'processed' end as status,
  case when ok = 0 then concat('no usable payload among ', records, ' records') end as error from r
union all select 'absent', null, 0, 0, 0.0::double, true, 'failed', 'no records'""")
def aggregation_report_errors(spark, d):
    """R-32: a subset of symbols, one with broken payloads, one that has no record."""
    r = views.records(spark, d).withColumn("ohlcv_data", F.when(F.col("symbol") == "view", '{"open":"none"}').otherwise(F.col("ohlcv_data")))
    out = daily.report(r, 70, symbols=["click", "view", "absent"])
    return out.withColumn("dt", F.date_format("dt", "yyyy-MM-dd"))


@query(f"""with {RECORDS}, v as (select symbol, timestamp, json_extract(ohlcv_data, '$.close')::double as close from records where cast(timestamp as date) = date '2024-01-15')
select symbol, epoch_us(timestamp) as ts_us, {rd("close")}, {rd(f"case when count(close) {_DAY} = 20 then avg(close) {_DAY} end", "close_mean")},
{rd(f"case when count(close) {_DAY} = 20 then stddev_samp(close) {_DAY} end", "close_std")}, count(*) over (partition by symbol) as day_rows from v""")
def daily_parts(spark, d):
    """ST-2 in parts: three runs of eight hours, each reading its own records, the second one repeated."""
    day = rec.read_records(spark, _store(spark, d)).filter(F.col("dt") == F.lit("2024-01-15").cast("date"))
    out, counts = scratch_path(spark, "parts"), None
    for batch in (0, 1, 1, 2):
        part = day.where(F.floor(F.hour("timestamp") / 8) == batch)
        counts = daily.run_part(spark, part, out, "hours", batch, 20, DAYS) or counts
    back = daily.read_parts(spark, out).select(F.col("symbol").cast("string").alias("symbol"), F.unix_micros("timestamp").alias("ts_us"), "close", "close_mean", "close_std")
    return back.join(counts.select("symbol", F.col("rows").alias("day_rows")), "symbol")


# -- streaming ------------------------------------------------------------------------------------


def _stream(spark, d, name):
    """The table's file as a stream, zone-less times as UTC instants."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    zoneless = {f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return raw.withColumns(zoneless)


_WAVES = [("ts < timestamp '2024-01-16'", 1), ("ts >= timestamp '2024-01-16'", 2), ("event_id % 3 = 0", 10), ("event_id % 5 = 0", 100)]


@query(f"""with told as ({" union all ".join(f"select event_type, ts, event_id, {n} as wave, value + {more} + 1 as v from events where {where}" for n, (where, more) in enumerate(_WAVES))}),
last as (select event_type, ts, max_by(v, (wave, event_id)) as v from told group by 1, 2)
select event_type as symbol, strftime(ts, '%Y-%m-%d') as day, count(*) as n, {rd("sum(v)", "total", 4)} from last group by 1, 2""", 4)
def stream_ingest(spark, d):
    """ST-1: a stream fed three times (the third restates stored bars), then a stream with a new checkpoint that
    restates bars once more, then its last batch a second time. Every bar arrives twice in a batch."""
    events = views.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.lit("tick").alias("interval"), F.col("ts").alias("timestamp"), "value", "event_id")
    path, inbox = scratch_path(spark, "ingest"), [scratch_path(spark, "inbox") for _ in range(2)]
    states = [scratch_path(spark, "ingest-state") for _ in range(2)]
    for n, (where, more) in enumerate(_WAVES):
        late = int(n == 3)
        wave = events.withColumnRenamed("timestamp", "ts").where(where).withColumnRenamed("ts", "timestamp").withColumn("value", F.col("value") + more)
        wave.write.mode("append").parquet(inbox[late])
        fed = spark.readStream.schema(events.schema).parquet(inbox[late])
        twice = fed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).withColumn("value", F.col("value") + F.col("copy"))
        ingest.upsert_stream(ingest.clean_stream(twice), path, states[late], order=("event_id", "copy")).awaitTermination()
    again = events.withColumn("value", F.lit(-1.0)).withColumn("copy", F.lit(0))
    commits.commit_bars(spark, path, again, commits.stream_writer(spark, states[1]), 0, ("event_id", "copy"))
    back = spark.read.parquet(path)
    return back.groupBy("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("""select event_type as symbol, strftime(ts, '%Y-%m-%d') as day, count(distinct ts) as n, round(sum(v) + 1.3e-9::double, 6) + 0.0::double as total
from (select event_type, ts, max(value) + 1 as v from events group by 1, 2) group by 1, 2""")
def upsert_store(spark, d):
    """S-4, stored: a first load, then a second one that repeats every bar with a later version of its value."""
    e = views.table(spark, d, "events")
    bars = e.groupBy(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp")).agg(F.max("value").alias("value"))
    bars = bars.withColumn("interval", F.lit("tick"))
    path = scratch_path(spark, "upsert-store")
    src.upsert_days(spark, path, bars.filter(F.dayofmonth("timestamp") % 2 == 0).withColumn("ingest_ts", F.lit(1)))
    src.upsert_days(spark, path, bars.withColumns({"value": F.col("value") + 1, "ingest_ts": F.lit(2)}))
    back = spark.read.parquet(path)
    return back.groupBy("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(f"""{_DYNAMIC} select symbol, id, sec, {rd("final_score", digits=5)}, {rd("quantile", digits=5)}, direction, reason is null as is_valid from done""", 5)
def stream_decisions(spark, d):
    """ST-3: decisions from keyed state, the same as the batch job's."""
    views.table(spark, d, "events")
    preds = with_even_scores(views.predictions_of(_stream(spark, d, "events")))
    path = scratch_path(spark, "decisions")
    decisions.start(decisions.decide_stream(preds, CFG), path, scratch_path(spark, "decisions-state")).awaitTermination()
    return spark.read.parquet(path).select("symbol", "id", "sec", "final_score", "quantile", "direction", "is_valid")


# -- configured jobs ------------------------------------------------------------------------------

CONFIG = {
    "default": "window",
    "methods": {"process_1": "window"},
    "jobs": {
        "window": {"steps": [{"type": "time_range", "start": "2024-01-10", "end": "2024-01-20"}, {"type": "previous_window_stats", "window": 12}]},
        "range": {"steps": [{"type": "time_range", "start": "2024-01-10", "end": "2024-01-20"}]},
    },
}
_TWELVE = "over (partition by symbol order by timestamp rows between 12 preceding and 1 preceding)"


@query(f"""with {BARS} select symbol, {TS}, {rd(f"case when count(close) {_TWELVE} = 12 then avg(close) {_TWELVE} end", "close_mean")} from bars
where timestamp between timestamp '2024-01-10' and timestamp '2024-01-20'""")
def configured_job(spark, d):
    """U-1: the default job's steps."""
    out = steps.run(views.bars(spark, d), CONFIG, steps.REGISTRY)
    return seconds(out.select("symbol", "timestamp", "close_mean"))


# -- predictions of the loss heads, labels ----------------------------------------------------------


@query(f"""{_LOSS}, b as (select *, list_transform(range(50), lambda i: (y_pred % (i + 3)) / 10) as wide from c),
e as (select *, list_transform(wide, lambda v: exp(v)) as ex from b)
select doc_id, {rd("1 / (1 + exp(-x))", "p")}, {rd("exp(z[1] - lse)", "share_0")}, {rd("exp(z[2] - lse)", "share_1")},
{rd("list_sum(list_transform(range(50), lambda i: ex[i + 1] * i / 49.0::double)) / list_sum(ex)", "expected")} from e""")
def loss_predictions(spark, d):
    """M-5, the prediction half: sigmoid, softmax, bucket expectation."""
    v = views.evalset(spark, d).join(views.table(spark, d, "labels").select("doc_id"), "doc_id")
    v = v.withColumn("x", (F.col("y_pred") % 200 - 100) / 20).withColumn("z", F.array((F.col("y_pred") % 7) / 3, (F.col("y_pred") % 11) / 4))
    wide = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: (F.col("y_pred") % (i + 3)) / 10)
    shares = evaluate.class_shares(F.col("z"))
    return v.select("doc_id", evaluate.probability(F.col("x")).alias("p"), F.get(shares, F.lit(0)).alias("share_0"), F.get(shares, F.lit(1)).alias("share_1"), evaluate.bucket_expectation(wide).alias("expected"))


@query(f"""select event_id, {rd("ln(1 + greatest(value - 50, 0))", "label")}, {rd("least(greatest((exp(ln(1 + greatest(value - 50, 0))) - 1) / 10, 0), 3)", "back")} from events""")
def label_transform(spark, d):
    """V-16: the forward label and its inverse."""
    e = views.table(spark, d, "events").select("event_id", log1p_label(F.col("value") - 50).alias("label"))
    return e.withColumn("back", expm1_label(F.col("label"), 3.0))
