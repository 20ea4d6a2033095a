"""The alpha features: a registry of names, each a formula over rolling series.

A feature is a function of the rolling builder, the base series and its parameters. Which features to
build, and with which parameters, is configuration (``{"alpha006": [60, 240], ...}``); names follow
``alphaNNN_new``, ``alphaNNN_w_new`` or ``alphaNNN_a_b_new``. Windows count rows, current row included,
and yield nothing until full. Several price-limit features take the minimum of highs and the maximum of
lows; that crossing is what the reference computes and is kept.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import rolling as R
from tickloom.functions.arrays import ArrayRolling
from tickloom.functions.layout import CHUNK, HALO, Chunking, chunked, unchunked
from tickloom.functions.rolling import Rolling, Series

log = logging.getLogger(__name__)

REGISTRY: dict[str, Callable[..., Series]] = {}
BASE = ("open", "high", "low", "close", "volume", "vwap", "returns")
OPTIONAL = ("market_cap",)
UNBOUNDED = ("alpha119", "alpha121")
NO_PARAMETER = ("alpha041", "alpha054", "alpha101", "alpha106", "alpha114", "alpha119", "alpha121", "alpha124")


def alpha(fn):
    REGISTRY[fn.__name__] = fn
    return fn


# -- momentum and trend ---------------------------------------------------------------------------


def _trend_follow(r: Rolling, close: Series, w: int, span: int) -> Series:
    """Change over w rows, kept when all changes of the span share a sign, else reversed."""
    d = r.delta(close, w)
    return R.when((r.min(d, span) > 0.0) | (r.max(d, span) < 0.0), d, -d)


@alpha
def alpha009(r, b, w):
    return _trend_follow(r, b.close, w, 5 * w)


@alpha
def alpha010(r, b, w):
    return _trend_follow(r, b.close, w, 4 * w)


@alpha
def alpha012(r, b, w):
    return r.delta(b.volume, w).sign() * -r.delta(b.close, w)


@alpha
def alpha013(r, b, w):
    return r.mean(b.close, 7 * w) / 7.0 * float(w) - b.close


@alpha
def alpha021(r, b, w):
    stretched = r.mean(b.close, 4 * w) + r.std(b.close, 4 * w) < r.mean(b.close, w)
    quiet = r.mean(b.volume, 10 * w) / b.volume < 1.0
    return R.when(stretched | quiet, -1.0, 1.0)


@alpha
def alpha023(r, b, w):
    return R.when(r.mean(b.high, 10 * w) < b.high, -r.delta(b.high, w).fill(), 0.0)


@alpha
def alpha024(r, b, w):
    n = 33 * w
    rise = r.delta(r.mean(b.close, n), n)
    base = r.lag(b.close, n)
    # a zero base divides to an infinity whose sign is that of the rise
    flat = R.when(base.same(0.0), rise < 0.0, rise / base <= 0.05)
    return R.when(flat, -(b.close - r.min(b.close, n)), -r.delta(b.close, 33))


def _bend(r: Rolling, close: Series, w: int) -> Series:
    """Change of slope over two spans of w rows; the divisor is 10 whatever w is."""
    near, far = r.lag(close, w), r.lag(close, 2 * w)
    return (far - near) / 10.0 - (near - close) / 10.0


@alpha
def alpha046(r, b, w):
    bend = _bend(r, b.close, w)
    return R.when(bend > 0.25, -1.0, R.when(bend < 0.0, 1.0, -r.delta(b.close, 1)))


@alpha
def alpha049(r, b, w):
    return R.when(_bend(r, b.close, w) < -0.1, 1.0, -r.delta(b.close, 1))


@alpha
def alpha051(r, b, w):
    return R.when(_bend(r, b.close, w) < -0.05, 1.0, -r.delta(b.close, 1))


@alpha
def alpha103(r, b, w):
    return r.pct(b.close, w)


@alpha
def alpha104(r, b, short, long):
    """1 on the row where the short mean crosses above the long one, else 0."""
    ms, ml = r.mean(b.close, short), r.mean(b.close, long)
    return R.when((ms > ml) & (r.lag(ms, 1) <= r.lag(ml, 1)), 1.0, 0.0)


@alpha
def alpha106(r, b):
    return r.delta(r.delta(b.close, 1), 1)


@alpha
def alpha107(r, b, w):
    top = r.max(b.close, w)
    return (b.close - top) / top


@alpha
def alpha118(r, b, w):
    return b.close - r.first_in(b.open, w)


@alpha
def alpha122(r, b, w):
    return r.pct(b.close, w) - r.pct(b.volume, w)


# -- price and volume together --------------------------------------------------------------------


@alpha
def alpha006(r, b, w):
    return (-r.corr(b.open, b.volume, w)).clean()


@alpha
def alpha014(r, b, w):
    return r.corr(b.vwap, r.lag(b.close, 5 * w), 230 * w)


@alpha
def alpha028(r, b, w):
    return r.corr(r.mean(b.volume, 4 * w), b.low, w).clean() + (b.high + b.low) / 2.0 - b.close


@alpha
def alpha110(r, b, w):
    return r.corr(b.close, b.volume, w).clean()


@alpha
def alpha113(r, b, w):
    return (b.volume / (r.mean(b.volume, w) + 1e-9) * r.pct(b.close, 1).fill()).clean()


@alpha
def alpha115(r, b, w):
    return r.std(b.volume * b.close, w)


@alpha
def alpha120(r, b, w):
    return (b.volume - r.mean(b.volume, w)) / r.std(b.volume, w)


@alpha
def alpha124(r, b):
    return (b.close - b.vwap) / b.vwap


@alpha
def alpha114(r, b):
    """Size-adjusted return; needs a ``market_cap`` column, which no shipped configuration asks for."""
    return (b.returns / (b.market_cap + 1e-9)).clean()


@alpha
def alpha126(r, b, w):
    """Money flow index."""
    typical = (b.high + b.low + b.close) / 3.0
    flow, before = typical * b.volume, r.lag(typical, 1)
    up = r.sum(R.when(typical > before, flow, 0.0), w)
    down = r.sum(R.when(typical < before, flow, 0.0), w)
    return R.number(100.0) - R.number(100.0) / (up / (down + 1e-6) + 1.0)


# -- bar shape ------------------------------------------------------------------------------------


def _nonzero(x: Series, value: float) -> Series:
    return R.when(x.same(0.0), value, x)


@alpha
def alpha041(r, b):
    return (b.high * b.low).map("sqrt", "sqrt({})") - b.vwap


@alpha
def alpha053(r, b, w):
    inner = ((b.close - b.low) - (b.high - b.close)) / _nonzero(b.close - b.low, 0.0001)
    return -r.delta(inner, w)


@alpha
def alpha054(r, b):
    fifth = R.number(5.0)
    down = _nonzero(b.low - b.high, -0.0001) * R.power(b.close, fifth)
    return -(b.low - b.close) * R.power(b.open, fifth) / down


@alpha
def alpha101(r, b):
    return (b.close - b.open) / (b.high - b.low + 0.001)


@alpha
def alpha116(r, b, w):
    return b.low / r.min(R.least(b.open, b.close), w) - 1.0


def _limits(r: Rolling, b, w: int) -> tuple[Series, Series]:
    return r.min(b.high, w), r.max(b.low, w)


@alpha
def alpha117(r, b, w):
    floor, top = _limits(r, b, w)
    return ((b.close - floor) - (top - b.close)) / (top - floor + 1e-6)


@alpha
def alpha123(r, b, w):
    floor, top = _limits(r, b, w)
    return (top - floor) / b.close


@alpha
def alpha125(r, b, w):
    floor, top = _limits(r, b, w)
    return (top - b.close) / (top - floor) * -100.0


# -- volatility and distribution ------------------------------------------------------------------


@alpha
def alpha102(r, b, w):
    """Relative strength with simple means, written so that no losses at all gives 1."""
    d = r.delta(b.close, 1)
    up = r.mean(d.map("up", "greatest({0}, 0.0D + 0 * {0})"), w)
    down = r.mean(d.map("down", "greatest(- {0}, 0.0D + 0 * {0})"), w)
    return up / (up + down)


@alpha
def alpha105(r, b, w):
    return r.pct(b.close, w) / r.std(b.returns, w)


@alpha
def alpha108(r, b, w):
    return r.std(r.pct(b.close, 1), w)


@alpha
def alpha109(r, b, w):
    risk = r.std(b.returns, w)
    return R.when(risk > 1e-6, r.mean(b.returns, w) / risk, 0.0).clean()


@alpha
def alpha111(r, b, w):
    return r.skew(b.returns, w).clean()


@alpha
def alpha112(r, b, w):
    mid, band = r.mean(b.close, w), r.std(b.close, w) * 2.0
    return ((b.close - (mid - band)) / ((mid + band) - (mid - band))).clean()


# -- ranks inside the window ----------------------------------------------------------------------


@alpha
def alpha007(r, b, w):
    d = r.delta(b.close, w // 3)
    return R.when(r.mean(b.volume, w) >= b.volume, -1.0, -r.rank(d.abs(), w) * d.sign())


@alpha
def alpha026(r, b, w):
    n = 5 * w
    together = r.corr(r.rank(b.volume, n), r.rank(b.high, n), n).clean()
    # a frame of any width: the ranks below it already come from the kernel pass
    return -r.max(together, 3 * w, native=True)


@alpha
def alpha035(r, b, w):
    one = R.number(1.0)
    shape = one - r.rank(b.close + b.high - b.low, w)
    return r.rank(b.volume, 2 * w) * shape * (one - r.rank(b.returns, 2 * w))


@alpha
def alpha043(r, b, w):
    busy = b.volume / r.mean(b.volume, 20 * w)
    return r.rank(busy, 20 * w) * r.rank(-r.delta(b.close, 7 * w), 8 * w)


@alpha
def alpha084(r, b, w):
    return R.power(r.rank_below_top(b.vwap, 15 * w, 21 * w), r.delta(b.close, 5 * w) / 1000.0)


# -- spectrum and wavelet -------------------------------------------------------------------------


@alpha
def alpha127(r, b, w):
    return r.kernel("peak_freq", b.close, w)


@alpha
def alpha128(r, b, w):
    return r.kernel("spectral_slope", b.close, w)


@alpha
def alpha129(r, b, w, threshold):
    return r.kernel("high_share", b.close, w, float(threshold))


@alpha
def alpha130(r, b, w):
    return r.kernel("spectral_entropy", b.close, w)


@alpha
def alpha131(r, b, w, level):
    return r.kernel("wavelet", b.close, w, int(level))


# -- configuration --------------------------------------------------------------------------------

TWO = [60, 240]
# The feature set served to the model, 100 features in this order.
DEFAULT_CONFIG: dict[str, list] = {
    "alpha006": TWO, "alpha007": TWO, "alpha009": TWO, "alpha010": TWO, "alpha012": TWO,
    "alpha013": [30, 40, 60], "alpha014": [30, 40, 60], "alpha021": TWO, "alpha023": TWO,
    "alpha024": TWO, "alpha026": TWO, "alpha028": TWO, "alpha035": TWO, "alpha041": [None],
    "alpha043": TWO, "alpha046": TWO, "alpha049": TWO, "alpha051": TWO, "alpha053": TWO,
    "alpha054": [None], "alpha084": TWO, "alpha101": [None], "alpha102": TWO, "alpha103": TWO,
    "alpha104": [[60, 240], [240, 720]], "alpha105": TWO, "alpha106": [None], "alpha107": TWO,
    "alpha108": TWO, "alpha109": TWO, "alpha110": TWO, "alpha111": TWO, "alpha112": [20, 60, 240],
    "alpha113": TWO, "alpha115": TWO, "alpha116": TWO, "alpha117": TWO, "alpha118": TWO,
    "alpha119": [None], "alpha120": TWO, "alpha121": [None], "alpha122": TWO, "alpha123": TWO,
    "alpha124": [None], "alpha125": TWO, "alpha126": TWO, "alpha127": TWO, "alpha128": TWO,
    "alpha129": [[60, 0.00556], [240, 0.00333]], "alpha130": TWO,
    "alpha131": [[60, 1], [240, 1], [60, 2], [240, 2]],
}

_THREE = [15, 60, 240]
# The wider research set, 143 features.
SHORT_CONFIG: dict[str, list] = {
    "alpha006": _THREE, "alpha007": _THREE, "alpha009": [3, 60, 240], "alpha010": _THREE,
    "alpha012": _THREE, "alpha013": [2, 30, 40, 60], "alpha014": [2, 30, 40, 60],
    "alpha021": [4, 60, 240], "alpha023": [2, 60, 240], "alpha024": [1, 60, 240],
    "alpha026": [3, 60, 240], "alpha028": [4, 60, 240], "alpha035": [7, 60, 240],
    "alpha041": [None], "alpha043": [2, 60, 240], "alpha046": _THREE, "alpha049": _THREE,
    "alpha051": _THREE, "alpha053": _THREE, "alpha054": [None], "alpha084": [3, 60, 240],
    "alpha101": [None], "alpha102": _THREE, "alpha103": _THREE,
    "alpha104": [[15, 60], [60, 240], [240, 720]], "alpha105": _THREE, "alpha106": [None],
    "alpha107": _THREE, "alpha108": _THREE, "alpha109": _THREE, "alpha110": _THREE,
    "alpha111": _THREE, "alpha112": [10, 20, 60, 240], "alpha113": _THREE, "alpha115": _THREE,
    "alpha116": _THREE, "alpha117": _THREE, "alpha118": _THREE, "alpha119": [None],
    "alpha120": _THREE, "alpha121": [None], "alpha122": _THREE, "alpha123": _THREE,
    "alpha124": [None], "alpha125": _THREE, "alpha126": _THREE, "alpha127": _THREE,
    "alpha128": _THREE, "alpha129": [[60, 0.00556], [240, 0.00333]], "alpha130": _THREE,
    "alpha131": [[15, 1], [60, 1], [240, 1], [60, 2], [240, 2]],
}


def load_config(path: str) -> dict[str, list]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def feature_name(name: str, params: tuple) -> str:
    return "_".join([name, *[str(p) for p in params], "new"])


def tasks(config: dict[str, list]) -> list[tuple[str, str, tuple]]:
    """(column, feature, parameters) in configuration order; unknown names are skipped with a warning."""
    out = []
    for name, entries in config.items():
        if name not in REGISTRY and name not in UNBOUNDED:
            log.warning("no feature named %s, skipped", name)
            continue
        for entry in entries:
            if entry is None or name in NO_PARAMETER:
                params: tuple = ()
            else:
                params = tuple(entry) if isinstance(entry, (list, tuple)) else (entry,)
            out.append((feature_name(name, params), name, params))
    return out


# -- features without a bounded window ------------------------------------------------------------


def _obv_step() -> Column:
    return F.when(F.col("returns") > 0, F.col("volume")).otherwise(-F.col("volume"))


def _carry(laid: DataFrame, own: Column) -> DataFrame:
    """One row per (symbol, chunk): what the chunks before it leave for it."""
    last_change = F.max(F.when(F.col("_changed") & own, F.col("_rn")))
    ends = (
        laid.filter(own)
        .groupBy("symbol", CHUNK)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            last_change.alias("_last_change"),
            F.max("_rn").alias("_last"),
            F.sum(_obv_step()).alias("_volume"),
        )
    )
    up_to = Window.partitionBy("symbol").orderBy(CHUNK)
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    length = F.when(F.col("_last_change").isNull(), F.col("_n")).otherwise(F.col("_last") - F.col("_last_change") + 1)
    ends = ends.select("*", length.alias("_length"), F.count("_last_change").over(up_to).alias("_group"))
    in_run = Window.partitionBy("symbol", "_group").orderBy(CHUNK)
    ends = ends.withColumn("_run", F.sum("_length").over(in_run))
    return ends.select(
        "symbol",
        CHUNK,
        F.coalesce(F.lag("_run").over(up_to), F.lit(0)).alias("_run_before"),
        F.coalesce(F.sum("_volume").over(before), F.lit(0.0)).alias("_volume_before"),
    )


def with_unbounded(laid: DataFrame, exact: bool) -> DataFrame:
    """Streak (119) and on-balance volume (121) over the whole history.

    Inside a chunk both are running frames. Across chunks only one small row per chunk travels - its
    volume sum, its length, the length of its last run - and comes back by an equi-join on
    (symbol, chunk), the partitioning the rows already have. ``exact`` says that a symbol may span
    several chunks and the carry is needed.
    """
    w = Window.partitionBy("symbol", CHUNK).orderBy("timestamp")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ~F.col(HALO)
    d = F.signum("returns")
    out = laid.select(
        "*",
        F.coalesce(d != F.lag(d, 1).over(w), F.lit(True)).alias("_changed"),
        F.row_number().over(w).alias("_rn"),
    )
    if exact:
        out = out.join(_carry(out, own), ["symbol", CHUNK])
    else:
        out = out.withColumns({"_run_before": F.lit(0), "_volume_before": F.lit(0.0)})
    out = out.select(
        "*",
        F.max(F.when(F.col("_changed") & own, F.col("_rn"))).over(running).alias("_from"),
        F.min(F.when(own, F.col("_rn"))).over(running).alias("_start"),
        F.sum(F.when(own, _obv_step()).otherwise(0.0)).over(running).alias("_obv"),
    )
    rn = F.col("_rn")
    length = F.when(F.col("_from").isNotNull(), rn - F.col("_from") + 1).otherwise(
        rn - F.col("_start") + 1 + F.col("_run_before")
    )
    return out.select(
        *laid.columns,
        (length * d).cast("double").alias("alpha119_new"),
        (F.col("_volume_before") + F.col("_obv")).alias("alpha121_new"),
    )


def formulas(r: Rolling, available: list[str], todo: list[tuple[str, str, tuple]]) -> dict[str, Series]:
    b = SimpleNamespace(**{c: r.source(c) for c in (*BASE, *OPTIONAL) if c in available})
    return {column: REGISTRY[name](r, b, *params) for column, name, params in todo if name in REGISTRY}


BAR_NUMBERS = [
    "open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades",
    "taker_buy_base_vol", "taker_buy_quote_vol",
]


def with_base(laid: DataFrame, compat_float32: bool = False) -> DataFrame:
    """Bar numbers as double plus ``vwap`` and ``returns``, on an already laid out frame."""

    def narrow(c: Column) -> Column:
        return c.cast("float").cast("double") if compat_float32 else c.cast("double")

    present = [c for c in BAR_NUMBERS if c in laid.columns]
    rest = [c for c in laid.columns if c not in present and c not in ("vwap", "returns")]
    out = laid.select(*rest, *[narrow(F.col(c)).alias(c) for c in present])
    before = F.lag("close", 1).over(Window.partitionBy("symbol", CHUNK).orderBy("timestamp"))
    return out.select(
        "*",
        narrow(F.try_divide("quote_asset_volume", "volume")).alias("vwap"),
        narrow(F.coalesce(F.try_divide("close", before) - 1, F.lit(0.0))).alias("returns"),
    )


def _in_arrays(laid: DataFrame, todo: list[tuple[str, str, tuple]], available: list[str], kept: list[str]) -> DataFrame:
    """All formulas of a group at once; rows sent along as context are dropped here."""
    inputs = [c for c in (*BASE, *OPTIONAL) if c in available]
    through = {f"{n}_new" for n in UNBOUNDED} & set(laid.columns)
    names = [c for c, n, _ in todo if n in REGISTRY]
    fed = laid.select(*kept, *sorted(through - set(kept)), CHUNK, HALO)
    keep = [c for c in fed.columns if c != CHUNK]
    schema = T.StructType([fed.schema[c] for c in keep] + [T.StructField(f"_f{i}", T.DoubleType()) for i in range(len(names))])

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp", kind="stable")
        own = ~pdf[HALO].to_numpy(dtype=bool)
        if not own.any():
            return pd.DataFrame({f.name: [] for f in schema.fields})
        r = ArrayRolling({c: pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in inputs})
        found = formulas(r, inputs, todo)
        values = {f"_f{i}": np.broadcast_to(found[c].v, (len(pdf),)).astype("float64")[own] for i, c in enumerate(names)}
        return pd.concat([pdf.loc[own, keep].reset_index(drop=True), pd.DataFrame(values)], axis=1)

    done = fed.groupBy("symbol", CHUNK).applyInPandas(per_group, schema)
    return done.select(*keep, *[F.nullif(F.col(f"_f{i}"), F.lit(float("nan"))).alias(c) for i, c in enumerate(names)])


def compute(
    bars: DataFrame,
    config: dict[str, list] | None = None,
    chunking: Chunking | None = Chunking(),
    rolling: Rolling | None = None,
    compat_float32: bool = False,
    arrays: bool = False,
) -> DataFrame:
    """``bars`` with ``vwap`` and ``returns`` (derived when absent) plus one column per configured feature.
    ``arrays`` evaluates the formulas in one Arrow pass over the (symbol, chunk) groups instead of as window
    expressions: the same numbers, and the better plan for more than a few dozen features.

    With ``chunking`` the history of a symbol may be any length. Without it every symbol is one group, for
    series already cut to a bounded tail. An empty configuration adds no feature.
    """
    todo = tasks(DEFAULT_CONFIG if config is None else config)
    r = rolling or Rolling()
    derive = not {"vwap", "returns"} <= set(bars.columns)
    columns = bars.columns if derive is False else [*bars.columns, "vwap", "returns"]
    outputs = formulas(r, columns, todo)
    halo = max(R.lookback(outputs), 1) + 1
    laid = chunked(bars, halo, chunking) if chunking else unchunked(bars)
    if derive:
        laid = with_base(laid, compat_float32)
    kept = [c for c in laid.columns if c not in (CHUNK, HALO)]
    if any(name in UNBOUNDED for _, name, _ in todo):
        laid = with_unbounded(laid, exact=chunking is not None)
        outputs |= {f"{n}_new": r.source(f"{n}_new") for n in UNBOUNDED}
    if arrays:
        out = _in_arrays(laid, todo, columns, kept)
    else:
        out = r.select(laid, outputs, keep=(*kept, HALO))
    order = [column for column, _, _ in todo]
    return out.filter(~F.col(HALO)).select(*[F.col(f"`{c}`") for c in [*kept, *order]])
