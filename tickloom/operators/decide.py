"""Trade decisions from model outputs: score, rolling quantile, direction, stop, size, checks.

The steps are Column expressions over a predictions table with ``symbol``, ``timestamp``, ``id``. Two rule
sets exist and stay apart: ``first`` and ``ple``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import CHUNK, HALO, Chunking, chunked, unchunked
from tickloom.functions.numeric import expm1_label
from tickloom.functions.rolling import Rolling
from tickloom.session import materialize


@dataclass(frozen=True)
class StrategyConfig:
    """The serving defaults."""

    top_threshold: float = 0.98
    bottom_threshold: float = 0.02
    queue_length: int = 1440
    k: float = 2.0
    quantile_mode: int = 2
    min_long_threshold: float = 8.2
    min_short_threshold: float = 5.9
    kelly_factor: float = 0.5
    sigma_mul: float = 3.0
    sharpe_bins: tuple = field(default=(0.0, 0.25, 0.5, 0.6, 1.0, 1.5))
    leverage_list: tuple = field(default=(1, 1, 1, 1, 1, 1))
    recent_seconds: int = 3600


NO_QUANTILE = -999.0
# Reason texts.
FAIL_DATA = "[fail] Insufficient data for quantile_retriever"
FAIL_MISSING = "[fail] Missing values for cal_value_tree calculation"
FAIL_RANGE = "[fail] quantile not in trading thresholds in cal_direction"
FAIL_STOP = "[fail] stop_loss_price is empty in cal_position_rate"
FAIL_LEVERAGE = "[fail] leverage is 0 in order_validate"
FAIL_KELLY = "[fail] kelly_ratio <= 0 in order_validate"
FAIL_LONG = "[fail] y0_trmt below min_long_threshold in order_validate"
FAIL_SHORT = "[fail] y0_ctrl below min_short_threshold in order_validate"


# -- row-wise steps -------------------------------------------------------------------------------


def decode(preds: DataFrame, strategy: str = "ple") -> DataFrame:
    """Heads to y0 (return), y1 (sigma) and t, and the score. ``ple`` inverts the label transform and
    takes the up-probability of the two t heads; ``first`` reads the raw heads."""
    if strategy == "ple":
        out = {
            "y0_trmt": expm1_label(F.col("trmt_return_1h_out"), 30.0),
            "y0_ctrl": expm1_label(F.col("ctrl_return_1h_out"), 30.0),
            "y1_trmt": expm1_label(F.col("trmt_sigma_1h_out"), 25.0),
            "y1_ctrl": expm1_label(F.col("ctrl_sigma_1h_out"), 25.0),
            "t": F.exp("t_trmt_out") / (F.exp("t_trmt_out") + F.exp("t_ctrl_out")),
        }
    else:
        out = {
            "y0_trmt": F.col("trmt_return_1h_out"),
            "y0_ctrl": F.col("ctrl_return_1h_out"),
            "y1_trmt": F.col("trmt_sigma_1h_out"),
            "y1_ctrl": F.col("ctrl_sigma_1h_out"),
            "t": F.col("t_out"),
        }
    return preds.withColumns(out).withColumn("final_score", F.col("t"))


def sharpe(cfg: StrategyConfig) -> Column:
    """Score over a piecewise volatility, for the direction of the row."""
    up, down = F.col("t"), 1 - F.col("t")

    def low(y1, y0):
        return F.greatest(y1 - y0 / 2.0, F.lit(0.0))

    trmt, ctrl = (F.col("y1_trmt"), F.col("y0_trmt")), (F.col("y1_ctrl"), F.col("y0_ctrl"))

    def other(y1, y0):
        return y1 + y0 / 2.0 - low(y1, y0)

    vol = F.when(F.col("direction") == "LONG", low(*trmt) * up + other(*ctrl) * down + 1e-6).when(
        F.col("direction") == "SHORT", low(*ctrl) * down + other(*trmt) * up + 1e-6
    )
    return F.try_divide(F.abs("final_score"), vol)


def leverage(cfg: StrategyConfig, strategy: str) -> Column:
    """``first`` looks the ratio up in half-open bins, last entry beyond them; ``ple`` always uses the last."""
    last = F.lit(float(cfg.leverage_list[-1]))
    has = F.col("direction") != ""
    if strategy == "ple":
        return F.when(has, last)
    ratio, out = sharpe(cfg), F.when(F.lit(False), last)
    for i, (a, b) in enumerate(zip(cfg.sharpe_bins, cfg.sharpe_bins[1:])):
        out = out.when((ratio >= a) & (ratio < b), F.lit(float(cfg.leverage_list[i])))
    return F.when(has, out.otherwise(last))


def with_stop(df: DataFrame, cfg: StrategyConfig, strategy: str) -> DataFrame:
    """Target and stop price. The stop moves away in whole steps of sigma until it is past the current
    price (``first``) or one step beyond it (``ple``); the number of steps has a closed form. A zero step
    that would never get there gives no stop."""
    cur = F.col("cur_price")
    long = F.col("direction") == "LONG"
    short = F.col("direction") == "SHORT"
    target = F.when(long, cur * (1 + F.col("y0_trmt") / 1000)).when(short, cur * (1 - F.col("y0_ctrl") / 1000))
    sigma = F.when(long, F.col("y1_trmt")).when(short, F.col("y1_ctrl"))
    out = df.withColumn("target_price", target).withColumn("_mid", (F.col("target_price") + cur) / 2)
    out = out.withColumn("_step", F.col("_mid") * sigma / 1000)
    out = out.withColumn("_side", F.when(long, F.lit(-1.0)).when(short, F.lit(1.0)))
    start = F.col("_mid") + F.col("_side") * cfg.sigma_mul * F.col("_step")
    limit = cur + F.col("_side") * F.col("_step") if strategy == "ple" else cur
    short_by = (limit - start) * F.col("_side")
    steps = F.when(short_by <= 0, F.lit(0)).otherwise(F.ceil(F.try_divide(short_by, F.col("_step"))))
    stop = start + F.col("_side") * F.col("_step") * steps
    return out.withColumn("stop_loss_price", stop).drop("_mid", "_step", "_side")


def kelly(cfg: StrategyConfig, strategy: str) -> Column:
    """Half-Kelly share after a 0.001 fee (``first``), or a constant 0.1 (``ple``)."""
    if strategy == "ple":
        return F.when(F.col("stop_loss_price").isNotNull(), F.lit(0.1))
    cur, t, fee = F.col("cur_price"), F.col("t"), F.col("cur_price") * 0.001
    side = F.when(F.col("direction") == "LONG", 1).when(F.col("direction") == "SHORT", -1)
    win = (F.col("target_price") - cur) * side - fee
    loss = (cur - F.col("stop_loss_price")) * side + fee
    p = F.when(F.col("direction") == "LONG", t).otherwise(1 - t)
    return (p - F.try_divide(1 - p, F.try_divide(win, loss) + 1e-6)) * cfg.kelly_factor


def fail_reason(cfg: StrategyConfig) -> Column:
    """The first failing check, in order; NULL when the row is fine."""
    d = F.col("direction")
    return F.coalesce(
        F.when(F.col("final_score").isNull(), FAIL_MISSING),
        F.when(F.col("quantile") == NO_QUANTILE, FAIL_DATA),
        F.when(d == "", FAIL_RANGE),
        F.when(F.col("stop_loss_price").isNull(), FAIL_STOP),
        F.when(F.col("leverage") == 0, FAIL_LEVERAGE),
        F.when(F.col("position_ratio").isNull() | (F.col("position_ratio") <= 0), FAIL_KELLY),
        F.when((d == "LONG") & (F.col("y0_trmt") < cfg.min_long_threshold), FAIL_LONG),
        F.when((d == "SHORT") & (F.col("y0_ctrl") < cfg.min_short_threshold), FAIL_SHORT),
    )


# -- rolling quantile -----------------------------------------------------------------------------


def score_quantile(scored: DataFrame, queue: int = 1440, chunking: Chunking | None = Chunking(), order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Share of the ``queue`` previous scores strictly below the current one, -999 until there are that
    many. Missing scores take no place in the queue and get -999 themselves."""
    some = scored.filter(F.col("final_score").isNotNull())
    r = Rolling(order=order)
    x = r.source("final_score")
    if queue < r.rank_limit:
        queued = r.previous("collect_list({})", x, queue)
        share = queued.map("share", f"CASE WHEN size({{0}}) = {queue} THEN size(filter({{0}}, _v -> _v < {x.sql})) / {float(queue)}D END")
    else:
        share = r.kernel("share_below", x, queue + 1)
    laid = chunked(some, queue, chunking) if chunking else unchunked(some)
    ranked = r.select(laid, {"quantile": share.fill(NO_QUANTILE)}).filter(~F.col(HALO)).drop(CHUNK, HALO)
    none = scored.filter(F.col("final_score").isNull()).withColumn("quantile", F.lit(NO_QUANTILE))
    return ranked.unionByName(none)


def static_direction(cfg: StrategyConfig, strategy: str, top: Column | None = None, bottom: Column | None = None) -> Column:
    q, s = F.col("quantile"), F.col("final_score")
    top = F.lit(cfg.top_threshold) if top is None else top
    bottom = F.lit(cfg.bottom_threshold) if bottom is None else bottom
    long, short = q >= top, q <= bottom
    if strategy == "first":
        long, short = long & (s > 0), short & (s < 0)
    return F.when(q == NO_QUANTILE, "").when(long, "LONG").when(short, "SHORT").otherwise("")


def finish(df: DataFrame, cfg: StrategyConfig, strategy: str) -> DataFrame:
    """Everything after the direction: leverage, stop, size, checks."""
    out = with_stop(df.withColumn("leverage", leverage(cfg, strategy)), cfg, strategy)
    out = out.withColumn("position_ratio", kelly(cfg, strategy)).withColumn("fail_reason", fail_reason(cfg))
    return out.withColumn("is_valid", F.col("fail_reason").isNull())


def recent_valid(decided: DataFrame, cfg: StrategyConfig = StrategyConfig(), bucket_seconds: int = 21600) -> DataFrame:
    """Valid decisions per direction in the hour before each row, rows of the same second in id order.

    Rows meet inside (symbol, time bucket); a valid row is also sent to the next bucket when an hour from
    it reaches there, so no symbol is one task.
    """
    span = cfg.recent_seconds
    sec = F.unix_timestamp("timestamp")
    own = F.floor(sec / bucket_seconds)
    reach = F.when(F.col("is_valid"), F.floor((sec + span) / bucket_seconds)).otherwise(own)
    laid = decided.withColumn("_sec", sec).withColumn("_own", own).withColumn("_bucket", F.explode(F.sequence(own, reach)))
    # running counts: those before this row less those before its hour; the work per row does not grow with the hour
    before = Window.partitionBy("symbol", "_bucket").orderBy("_sec", "id").rowsBetween(Window.unboundedPreceding, -1)
    gone = Window.partitionBy("symbol", "_bucket").orderBy("_sec").rangeBetween(Window.unboundedPreceding, -span - 1)
    for d in ("LONG", "SHORT"):
        hit = (F.col("direction") == d) & F.col("is_valid")
        laid = laid.withColumn(f"recent_{d.lower()}", F.count_if(hit).over(before) - F.count_if(hit).over(gone))
    return laid.filter(F.col("_bucket") == F.col("_own")).drop("_sec", "_own", "_bucket")


CONTEXT = 256  # earlier candidates from which a piece guesses its start
_STEP = "symbol string, direction string, _chunk bigint, _us bigint, id bigint, first_sec bigint, assumed array<bigint>, ended array<bigint>"
_PIECE = ["symbol", "direction", CHUNK]


def _walked(rows: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """Walk the pieces in order of time, as a stream over sorted partitions. ``kind`` 0: an accepted second to start
    from, 1: context, 2: a row of the piece. Accepted rows come out, and for every piece one row without id: the accepted
    seconds of the last hour that it started from and that it ended with."""
    ordered = rows.repartition(*_PIECE).sortWithinPartitions(*_PIECE, "kind", "timestamp", "id")
    top, bottom, k, span = cfg.top_threshold, cfg.bottom_threshold, cfg.k, cfg.recent_seconds

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, recent, first, assumed = None, [], None, []

        def border():
            return [(*piece, None, None, first, assumed, recent)] if first is not None else []

        for pdf in batches:
            out = []
            for key, kind, at, us, row, q in zip(zip(pdf["symbol"], pdf["direction"], pdf[CHUNK]), pdf["kind"], pdf["_sec"], pdf["_us"], pdf["id"], pdf["quantile"]):
                if key != piece:
                    out += border()
                    piece, recent, first = key, [], None
                if kind == 0:
                    recent.append(at)
                    continue
                recent = [s for s in recent if s >= at - span]
                if kind == 2 and first is None:
                    first, assumed = at, recent
                share = k * len(recent) + 1
                ok = q >= 1.0 - (1.0 - top) / share if key[1] == "LONG" else q <= bottom / share
                if ok:
                    recent = [*recent, at]
                    if kind == 2:
                        out.append((*key, us, row, None, None, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STEP.split(", ")])
        if piece is not None:
            yield pd.DataFrame(border(), columns=[c.split()[0] for c in _STEP.split(", ")])

    return ordered.mapInPandas(walk, _STEP)


def _accepted(could: DataFrame, cfg: StrategyConfig, chunking: Chunking, context: int) -> DataFrame:
    """The candidates (symbol, _us, id) that the tightening thresholds let pass.

    Candidates of a symbol and direction are cut into pieces of ``chunking.rows``, all walked at once: a piece guesses
    the accepted seconds before it from ``context`` earlier rows. Then neighbours are compared. A piece whose
    guess differs from what the piece before it ended with is walked again from there, until every border
    agrees; the first piece is always right, so each round settles at least one more, mostly all.
    """
    by = Chunking(chunking.rows, chunking.micro_seconds, chunking.order, ("symbol", "direction"))
    laid = chunked(could, context, by).withColumn("kind", F.when(F.col(HALO), 1).otherwise(2)).drop(HALO)
    laid = materialize(laid, "candidates")
    done = materialize(_walked(laid, cfg), "walked")
    before = Window.partitionBy("symbol", "direction").orderBy(CHUNK)
    told = F.filter(F.coalesce(F.lag("ended").over(before), F.array().cast("array<bigint>")), lambda s: s >= F.col("first_sec") - cfg.recent_seconds)
    while True:
        borders = done.where("id is null").withColumn("told", told)
        wrong = materialize(borders.where(F.array_sort("told") != F.array_sort("assumed")).select(*_PIECE, "told"), "wrong")
        if wrong.isEmpty():
            return done.where("id is not null").select("symbol", "_us", "id")
        again = laid.where("kind = 2").join(wrong.drop("told"), _PIECE, "left_semi")
        start = wrong.select(*_PIECE, F.explode("told").alias("_sec"), F.lit(0).alias("kind"))
        walked = _walked(again.unionByName(start, allowMissingColumns=True), cfg)
        done = materialize(done.join(wrong.drop("told"), _PIECE, "left_anti").unionByName(walked), "walked")


def dynamic_direction(
    quantiled: DataFrame, cfg: StrategyConfig, strategy: str, chunking: Chunking = Chunking(), cut: bool = True, context: int = CONTEXT
) -> DataFrame:
    """Thresholds that tighten with the symbol's own valid decisions of the last hour.

    A decision depends on earlier decisions, but only through rows that pass the untightened thresholds
    and all later checks, only within its own direction, and only one hour back. So only the few rows that
    could be valid are walked in time order, in pieces of bounded size; all other rows are decided by expressions.
    ``cut`` writes the untightened decisions to the shared folder, for they are read three times.
    """
    static = finish(quantiled.withColumn("direction", static_direction(cfg, strategy)), cfg, strategy)
    if cut:
        static = materialize(static, "decisions")
    could = static.filter("is_valid").select("symbol", "direction", "timestamp", "id", "quantile", F.unix_timestamp("timestamp").alias("_sec"), F.unix_micros("timestamp").alias("_us"))
    accepted = _accepted(could, cfg, chunking, context).withColumn("_accepted", F.lit(True))
    out = static.withColumn("_us", F.unix_micros("timestamp")).join(accepted, ["symbol", "_us", "id"], "left")
    refused = F.col("is_valid") & F.col("_accepted").isNull()
    # rows that passed the base thresholds but not a later check keep their direction only if the
    # tightened threshold lets them; that needs the count of accepted rows before them
    return _apply_counts(out.withColumn("is_valid", F.col("is_valid") & ~refused), quantiled.columns, cfg, strategy)


def _apply_counts(decided: DataFrame, columns: list[str], cfg: StrategyConfig, strategy: str) -> DataFrame:
    counted = recent_valid(decided, cfg)
    tight_top = 1.0 - (1.0 - cfg.top_threshold) / (cfg.k * F.col("recent_long") + 1)
    tight_bottom = F.lit(cfg.bottom_threshold) / (cfg.k * F.col("recent_short") + 1)
    again = counted.select(*columns, "recent_long", "recent_short")
    return finish(again.withColumn("direction", static_direction(cfg, strategy, tight_top, tight_bottom)), cfg, strategy)


def decide(preds: DataFrame, strategy: str = "ple", cfg: StrategyConfig = StrategyConfig(), chunking: Chunking = Chunking()) -> DataFrame:
    """Predictions to decisions: one row each, valid or with its first failing reason."""
    quantiled = score_quantile(decode(preds, strategy), cfg.queue_length, chunking)
    if cfg.quantile_mode == 2:
        return dynamic_direction(quantiled, cfg, strategy, chunking)
    return finish(quantiled.withColumn("direction", static_direction(cfg, strategy)), cfg, strategy)


def new_orders(decided: DataFrame) -> DataFrame:
    return decided.filter("is_valid").select(
        "id", "symbol", "direction", F.col("position_ratio").alias("kelly_rate"), F.col("leverage").cast("int").alias("leverage"),
        F.col("stop_loss_price").alias("stop_loss"), F.lit("NEW").alias("status"), F.unix_timestamp("timestamp").alias("created_at"),
    )


def score_rows(decided: DataFrame) -> DataFrame:
    return decided.select(
        "id", "symbol", F.unix_timestamp("timestamp").alias("timestamp"), "final_score", "quantile", "direction", "leverage",
        "cur_price", "stop_loss_price", "position_ratio", "is_valid", F.coalesce("fail_reason", F.lit("")).alias("fail_reason"),
    )
