"""The feature job: bars to standardised, fixed-width vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import kernels
from tickloom.functions import rolling as R
from tickloom.functions.arrays import ArrayRolling
from tickloom.functions.layout import CHUNK, HALO, Chunking, chunked, tail_rows, unchunked
from tickloom.functions.numeric import zero_missing_columns
from tickloom.functions.rolling import Rolling
from tickloom.operators import alphas
from tickloom.session import materialize

# The columns kept out of the z-score.
RANK_COLUMNS = ["alpha021_60_new", "alpha021_240_new", "alpha104_60_240_new", "alpha104_240_720_new"]
KEYS = ("symbol", "timestamp")


def base_columns(bars: DataFrame, chunking: Chunking | None = Chunking(), compat_float32: bool = False) -> DataFrame:
    """Numeric columns as double, plus ``vwap`` and ``returns`` (first row of a symbol: 0).

    ``compat_float32`` rounds inputs and derived columns to single precision, as the reference stores them.
    """
    laid = chunked(bars, 1, chunking) if chunking else unchunked(bars)
    out = alphas.with_base(laid, compat_float32).filter(~F.col(HALO))
    return out.drop(CHUNK, HALO)


# -- z-scores -------------------------------------------------------------------------------------


def _z(
    df: DataFrame,
    columns: list[str],
    z_window: int,
    vol_window: int | None,
    chunking: Chunking | None,
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """One matrix pass per chunk, whatever the number of columns."""
    rest = [c for c in df.columns if c not in columns]
    halo = z_window + 1 + (vol_window + 1 if vol_window else 0)
    laid = chunked(df, halo, chunking, counts_from) if chunking else unchunked(df)
    out = kernels.standardise_columns(laid, columns, z_window, vol_window, ("symbol", CHUNK), "timestamp", [*rest, HALO])
    return out.filter(~F.col(HALO)).select(*[F.col(f"`{c}`") for c in df.columns])


def _numeric(df: DataFrame, exclude: tuple[str, ...]) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude and f.name not in KEYS
    ]


def rolling_z_score(
    df: DataFrame,
    window: int = 10000,
    exclude: tuple[str, ...] = (),
    chunking: Chunking | None = Chunking(),
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """Every numeric column against the mean and deviation of the ``window`` rows before it."""
    return _z(df, _numeric(df, exclude), window, None, chunking, counts_from)


def rolling_z_score_vol(
    df: DataFrame,
    vol_window: int = 60,
    z_window: int = 10000,
    exclude: tuple[str, ...] = (),
    chunking: Chunking | None = Chunking(),
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """As ``rolling_z_score``, on values divided by the deviation of their own relative changes."""
    return _z(df, _numeric(df, exclude), z_window, vol_window, chunking, counts_from)


def z_score_stats(df: DataFrame, window: int, columns: list[str], chunking: Chunking | None = Chunking()) -> DataFrame:
    """Mean and deviation that the newest row of each symbol is standardised with, one row per column."""
    r = Rolling()
    outputs = {}
    for c in columns:
        outputs[f"{c}__mean"], outputs[f"{c}__std"] = r.before(r.source(c), window)
    laid = chunked(df, R.lookback(outputs), chunking) if chunking else unchunked(df)
    out = r.select(laid, outputs, keep=(*KEYS, HALO)).filter(~F.col(HALO))
    newest = out.groupBy("symbol").agg(*[F.max_by(F.col(n), "timestamp").alias(n) for n in outputs])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std")) for c in columns]
    return newest.select("symbol", F.inline(F.array(*pairs)))


def z_score_static(df: DataFrame, stats: dict[str, dict[str, float]]) -> DataFrame:
    """Standardise with given statistics; columns without them, or with no deviation, pass through."""
    out = []
    for c in df.columns:
        s = stats.get(c)
        if s and s["std"] != 0:
            out.append(((F.col(f"`{c}`") - F.lit(float(s["mean"]))) / F.lit(float(s["std"]))).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


# -- vectors --------------------------------------------------------------------------------------


def fixed_width(columns: list[str], width: int) -> Column:
    """Vector of exactly ``width`` doubles.

    Too many columns: those that are finite and below 10 in size come first, in column order, then the
    rest, cut at ``width``. Too few: padded with zeros. Width 0 or less: an empty vector.
    """
    if width <= 0:
        return F.array().cast("array<double>")
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    if width < len(columns):
        fine = F.filter(values, lambda v: _tame(v))
        rest = F.filter(values, lambda v: ~_tame(v))
        return F.slice(F.concat(fine, rest), 1, width)
    if width > len(columns):
        return F.concat(values, F.array_repeat(F.lit(0.0), width - len(columns)))
    return values


def _tame(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) < 10.0), F.lit(False))


def feature_vectors(
    bars: DataFrame,
    width: int = 111,
    history: int = 14000,
    config: dict[str, list] | None = None,
    vol_window: int = 120,
    exclude: tuple[str, ...] = tuple(RANK_COLUMNS),
    chunking: Chunking = Chunking(),
    compat_float32: bool = False,
) -> DataFrame:
    """Serving form: one vector per symbol for its newest bar, from its last ``history + 1`` bars.

    The tail is bounded, so each symbol is one group of at most ``history + 1`` rows.
    """
    tail = tail_rows(bars, history + 1, chunking)
    if width <= 0:
        return tail.select("symbol").distinct().select("symbol", fixed_width([], 0).alias("features"))
    todo = alphas.tasks(alphas.DEFAULT_CONFIG if config is None else config)
    laid = alphas.with_base(unchunked(tail), compat_float32)
    numbers = _numeric(laid, (CHUNK,))
    if any(name in alphas.UNBOUNDED for _, name, _ in todo):
        laid = alphas.with_unbounded(laid, exact=False)
    names = [*numbers, *[column for column, _, _ in todo]]
    inputs = [c for c in (*alphas.BASE, *alphas.OPTIONAL) if c in laid.columns]
    apart = np.array([c in exclude for c in names])

    def newest(pdf: pd.DataFrame) -> pd.DataFrame:
        """A symbol's rows to its newest vector, in one pass: expressions per column would cost more than the data."""
        pdf = pdf.sort_values("timestamp", kind="stable")
        column = lambda c: pdf[c].to_numpy(dtype="float64", na_value=np.nan)
        built = alphas.formulas(ArrayRolling({c: column(c) for c in inputs}), inputs, todo)
        matrix = np.empty((len(pdf), len(names)))
        for k, c in enumerate(names):
            matrix[:, k] = built[c].v if c in built else column(c)
        matrix[~np.isfinite(matrix)] = 0.0
        last = matrix[-1].copy()
        last[~apart] = kernels.standardised(matrix[:, ~apart], history + 1, vol_window)[-1]
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[-1:], "timestamp": pdf["timestamp"].iloc[-1:], "features": [_fitted(last, width)]})

    fed = laid.select("symbol", "timestamp", *[c for c in laid.columns if c in {*inputs, *names}])
    schema = T.StructType([fed.schema["symbol"], fed.schema["timestamp"], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return fed.groupBy("symbol").applyInPandas(newest, schema)


def _fitted(values: np.ndarray, width: int) -> np.ndarray:
    """``fixed_width`` for one row of numbers."""
    if width < len(values):
        tame = np.abs(values) < 10.0
        values = np.concatenate((values[tame], values[~tame]))[:width]
    return np.concatenate((values, np.zeros(width - len(values))))


def feature_table(
    bars: DataFrame,
    config: dict[str, list] | None = None,
    vol_window: int | None = 120,
    z_window: int = 50000,
    exclude: tuple[str, ...] = tuple(RANK_COLUMNS),
    chunking: Chunking = Chunking(),
    cut: bool = False,
) -> DataFrame:
    """Every bar of every symbol, standardised: training form. ``vol_window`` None is the plain z-score.
    ``cut`` writes the alpha table to the shared folder before the z-scores; worth it for the full set,
    whose two halves are each a wide plan."""
    built = zero_missing_columns(alphas.compute(bars, config, chunking, arrays=True))
    if cut:
        built = materialize(built, "alphas")
    if vol_window is None:
        return rolling_z_score(built, z_window, exclude, chunking, bars)
    return rolling_z_score_vol(built, vol_window, z_window, exclude, chunking, bars)


def offline_matrix(bars: DataFrame, config=None, z_window: int = 50000, rows: int = 1440, chunking: Chunking = Chunking()) -> DataFrame:
    """Offline form: plain z-score, the last ``rows`` bars of each symbol as single-precision vectors."""
    table = tail_rows(feature_table(bars, config, None, z_window, (), chunking), rows, chunking)
    names = _numeric(table, ())
    return table.select(*KEYS, F.array(*[F.col(f"`{c}`").cast("float") for c in names]).alias("features"))


# -- window statistics of the daily aggregation ---------------------------------------------------

OHLCV = ["open", "high", "low", "close", "volume"]


def previous_window_stats(bars: DataFrame, window: int = 60, chunking: Chunking | None = Chunking()) -> DataFrame:
    """Mean and deviation of each price column over the ``window`` rows before the current one, NULL until
    that many exist (first valid row: index ``window``)."""
    laid = chunked(bars, window, chunking) if chunking else unchunked(bars)
    prev = Window.partitionBy("symbol", CHUNK).orderBy("timestamp").rowsBetween(-window, -1)
    out = [F.col(c) for c in bars.columns] + [F.col(HALO)]
    for c in OHLCV:
        full = F.count(c).over(prev) == window
        out.append(F.when(full, F.avg(c).over(prev)).alias(f"{c}_mean"))
        out.append(F.when(full, F.stddev_samp(c).over(prev)).alias(f"{c}_std"))
    return laid.select(*out).filter(~F.col(HALO)).drop(HALO)


def completeness(bars: DataFrame, expected: int = 1440, warn_below: float = 0.9) -> DataFrame:
    """Rows per symbol and day against the expected count."""
    n = F.count(F.lit(1))
    return bars.groupBy("symbol", F.to_date("timestamp").alias("dt")).agg(
        n.alias("rows"),
        (n / F.lit(float(expected)) * 100).alias("completeness_pct"),
        (n < F.lit(expected * warn_below)).alias("low"),
    )
