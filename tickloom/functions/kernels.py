"""Window measures that depend on the order of values inside the window.

Spark partitions, shuffles and sorts; a kernel only turns the rows of one bounded (symbol, chunk) group
into one number per row with numpy/pandas. All kernels of a job share one ``applyInPandas`` pass, which
reads the exchange and sort already made for the frames before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The eight decomposition low-pass taps of the Daubechies-4 wavelet.
DB4_LOW = [
    -0.010597401784997278,
    0.032883011666982945,
    0.030841381835986965,
    -0.18703481171888114,
    -0.02798376941698385,
    0.6308807679295904,
    0.7148465705525415,
    0.23037781330885523,
]
WAVELET_LEVELS = 4
BLOCK_CELLS = 4_000_000


@dataclass
class Kernel:
    kind: str
    name: str
    series: Any
    w: int
    params: tuple = ()
    other: Any = None  # second input of a pair measure


def db4_high() -> list[float]:
    return [(-1.0) ** (k + 1) * DB4_LOW[7 - k] for k in range(8)]


def _split(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """One filter-and-downsample step with half-point symmetric extension."""
    n, f = len(x), len(taps)
    ext = np.pad(x, f - 1, mode="symmetric")
    return np.convolve(ext, taps, mode="valid")[1::2][: (n + f - 1) // 2]


def detail_means(w: int, level: int) -> np.ndarray:
    """Weights of the mean detail coefficient: the decomposition is linear, so the measure of any window
    is its dot product with the measures of the unit vectors. ``level`` 1 is the coarsest detail."""
    low, high = np.array(DB4_LOW), np.array(db4_high())
    weights = np.empty(w)
    for i in range(w):
        approx = np.zeros(w)
        approx[i] = 1.0
        details = []
        for _ in range(WAVELET_LEVELS):
            details.append(_split(approx, high))
            approx = _split(approx, low)
        weights[i] = details[WAVELET_LEVELS - level].mean()
    return weights


def _spectral(kind: str, windows: np.ndarray, w: int, params: tuple) -> np.ndarray:
    half = w // 2
    power = np.abs(np.fft.rfft(windows, axis=1)[:, :half])
    freq = np.arange(half) / w
    if kind == "peak_freq":
        return (np.argmax(power[:, 1:], axis=1) + 1) / w
    if kind == "spectral_slope":
        u = np.log(freq[1:])
        u = u - u.mean()
        p = power[:, 1:]
        return -(np.log(np.where(p == 0, 1e-10, p)) @ u) / (u @ u)
    total = power.sum(axis=1)
    safe = np.where(total > 0, total, 1.0)
    if kind == "high_share":
        return np.where(total > 0, power[:, freq > params[0]].sum(axis=1) / safe, 0.0)
    share = np.clip(power / safe[:, None], 1e-12, 1.0)
    return np.where(total > 0, -(share * np.log(share)).sum(axis=1) / math.log(half), 0.0)


def evaluate(kind: str, x: np.ndarray, w: int, params: tuple = (), y: np.ndarray | None = None) -> np.ndarray:
    """One value per row; NaN until a window is full and has no hole (``spread`` and ``before_*`` take what is there)."""
    x = np.where(np.isfinite(x), x, np.nan)
    out = np.full(len(x), np.nan)
    if kind == "spread":
        return _trailing(x[:, None], w)[1][:, 0] if len(x) else out
    if kind in ("before_mean", "before_std"):
        if len(x):
            out[1:] = _trailing(x[:, None], w)[kind == "before_std"][:-1, 0]
        return out
    if kind in MOMENTS:
        return moment(kind, x, w, y)
    if len(x) < w:
        return out
    if kind == "rank_below_top":
        return evaluate("rank", x - evaluate("max", x, int(params[0])), w)
    if kind in ("min", "max"):
        return getattr(pd.Series(x).rolling(w), kind)().to_numpy()
    if kind == "product":
        return _window_products(x, w)
    if kind in ("rank", "share_below") and w > DIRECT_RANKS:
        return _ranked(kind, x, w)
    weights = detail_means(w, int(params[0])) if kind == "wavelet" else None
    views = np.lib.stride_tricks.sliding_window_view(x, w)
    step = max(1, BLOCK_CELLS // w)
    for at in range(0, len(views), step):
        block = views[at: at + step]
        if kind == "rank":
            last = block[:, -1:]
            got = (block < last).sum(axis=1) + ((block == last).sum(axis=1) + 1) / 2.0
        elif kind == "share_below":
            # newest value against the w-1 before it
            got = (block[:, :-1] < block[:, -1:]).sum(axis=1) / (w - 1.0)
        elif kind == "wavelet":
            got = block @ weights
        else:
            got = _spectral(kind, block, w, params)
        got = np.where(np.isnan(block).any(axis=1), np.nan, got)
        out[w - 1 + at: w - 1 + at + len(block)] = got
    return out


# -- order statistics -----------------------------------------------------------------------------

DIRECT_RANKS = 512  # up to here looking at every row of the window is as fast; the counts are the same


def counts_below(ranks: np.ndarray, start: np.ndarray, stop: np.ndarray, bounds: list[np.ndarray]) -> list[np.ndarray]:
    """How many of ``ranks[start:stop]`` lie below each bound, for all queries at once.

    Bit by bit from the top: the rows are split stably by the bit, zeros first, and a query follows its bound's bit,
    taking along all zeros of its stretch where the bound has a one. Work per query is one step a bit, whatever the
    stretch's length; one level is held at a time.
    """
    bits = max(1, int(max(ranks.max(initial=0), *(b.max(initial=0) for b in bounds))).bit_length())
    spans = [[start.copy(), stop.copy(), np.zeros(len(start), np.int64)] for _ in bounds]
    for bit in range(bits - 1, -1, -1):
        one = (ranks >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        for span, bound in zip(spans, bounds):
            a, b = zeros[span[0]], zeros[span[1]]
            up = (bound >> bit) & 1 == 1
            span[2] += np.where(up, b - a, 0)
            span[0], span[1] = np.where(up, zeros[-1] + span[0] - a, a), np.where(up, zeros[-1] + span[1] - b, b)
        ranks = np.concatenate((ranks[one == 0], ranks[one == 1]))
    return [span[2] for span in spans]


def _ranked(kind: str, x: np.ndarray, w: int) -> np.ndarray:
    """Average rank of the newest value of each window, or the share of the others below it."""
    known = ~np.isnan(x)
    dense = np.zeros(len(x), np.int64)
    dense[known] = np.unique(x[known], return_inverse=True)[1]
    stop = np.arange(w, len(x) + 1)
    newest = dense[stop - 1]
    out = np.full(len(x), np.nan)
    if kind == "rank":
        less, at_most = counts_below(dense, stop - w, stop, [newest, newest + 1])
        got = less + (at_most - less + 1) / 2.0
    else:
        got = counts_below(dense, stop - w, stop - 1, [newest])[0] / (w - 1.0)
    holes = np.concatenate(([0], np.cumsum(~known)))
    out[w - 1 :] = np.where(holes[stop] == holes[stop - w], got, np.nan)
    return out


def _window_products(x: np.ndarray, w: int) -> np.ndarray:
    """Product of each full window as the tail of one block of ``w`` rows times the head of the next; never divides."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.ones(blocks * w)
    padded[:n] = x
    cube = padded.reshape(blocks, w)
    heads = np.cumprod(cube, axis=1).reshape(-1)[:n]
    tails = np.cumprod(cube[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    out = np.full(n, np.nan)
    end = np.arange(w - 1, n)
    inner = (end + 1) % w != 0
    out[end] = heads[end] * np.where(inner, tails[end - w + 1], 1.0)
    return out


# -- moments of full windows ----------------------------------------------------------------------

MOMENTS = ("sum", "mean", "std", "skew", "cov", "corr")


def moment(kind: str, x: np.ndarray, w: int, y: np.ndarray | None = None) -> np.ndarray:
    """A moment of each full window of ``w`` rows without a hole, by window sums that never subtract; values are
    centred on the group's median, which no outlier moves. NaN elsewhere, and for a correlation with a constant side."""
    if y is not None:
        y = np.where(np.isfinite(y) & np.isfinite(x), y, np.nan)
        x = np.where(np.isnan(y), np.nan, x)
    known = ~np.isnan(x)
    if len(x) < w or not known.any():
        return np.full(len(x), np.nan)

    def moved(v):
        centre = np.median(v[known])
        return centre, np.where(known, v - centre, 0.0)

    cx, mx = moved(x)
    columns = [known.astype(float), mx]
    if kind in ("std", "skew", "corr"):
        columns.append(mx * mx)
    if kind == "skew":
        columns.append(mx**3)
    if y is not None:
        _, my = moved(y)
        columns += [my, my * my, mx * my]
    sums = _window_sums(np.stack(columns, axis=1), w)
    full = sums[:, 0] == w

    def steady(v):
        """Whether the window holds one value only: no change after its first row."""
        change = np.cumsum(np.concatenate(([0], v[1:] != v[:-1])))
        out = np.zeros(len(v), dtype=bool)
        out[w - 1 :] = change[w - 1 :] == change[: len(v) - w + 1]
        return out

    s1 = sums[:, 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        if kind == "sum":
            out = cx * w + s1
        elif kind == "mean":
            out = cx + s1 / w
        elif kind == "std":
            out = np.where(steady(mx), 0.0, np.sqrt(np.maximum(sums[:, 2] - s1 * s1 / w, 0.0) / (w - 1)))
        elif kind == "skew":
            mean = s1 / w
            spread = np.where(steady(mx), 0.0, np.maximum(sums[:, 2] / w - mean * mean, 0.0))
            third = sums[:, 3] / w - 3.0 * mean * sums[:, 2] / w + 2.0 * mean**3
            out = np.where(spread <= 1e-14, 0.0, third / spread**1.5 * (w * (w - 1.0)) ** 0.5 / (w - 2.0))
        else:
            sy, syy, sxy = sums[:, -3], sums[:, -2], sums[:, -1]
            cross = sxy - s1 * sy / w
            if kind == "cov":
                out = cross / (w - 1)
            else:
                scale = np.sqrt(np.maximum(sums[:, 2] - s1 * s1 / w, 0.0)) * np.sqrt(np.maximum(syy - sy * sy / w, 0.0))
                out = np.where(steady(mx) | steady(my) | (scale == 0), np.nan, np.clip(cross / scale, -1.0, 1.0))
    return np.where(full, out, np.nan)


# -- many columns at once -------------------------------------------------------------------------


def _window_sums(v: np.ndarray, w: int) -> np.ndarray:
    """Sums over up to ``w`` rows ending at each row, per column, without subtracting: rows are cut in
    blocks of ``w``, and a window is the tail of one block plus the head of the next. A huge value that has
    left the window leaves no trace, as it would in a difference of running sums."""
    n, c = v.shape
    w = min(w, n)
    blocks = -(-n // w)
    padded = np.zeros((blocks * w, c))
    padded[:n] = v
    cube = padded.reshape(blocks, w, c)
    heads = np.cumsum(cube, axis=1).reshape(-1, c)
    tails = np.cumsum(cube[:, ::-1], axis=1)[:, ::-1].reshape(-1, c)
    out = heads[:n].copy()
    # a window starting inside a block takes the rest of that block; one starting on its edge is whole
    inner = (np.arange(w, n) + 1) % w != 0
    rows = np.arange(w, n)[inner]
    out[rows] += tails[rows - w + 1]
    return out


def _trailing(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of up to ``w`` rows ending at each row, per column, holes skipped."""
    w = min(w, len(x))
    known = np.isfinite(x)
    holes = np.where(known, x, np.nan)
    centre = np.zeros(x.shape[1])
    some = known.any(axis=0)
    centre[some] = np.nanmedian(holes[:, some], axis=0)
    moved = np.where(known, x - centre, 0.0)
    n, s1, s2 = _window_sums(known.astype(float), w), _window_sums(moved, w), _window_sums(moved * moved, w)
    changes = np.ones_like(x)
    changes[1:] = (moved[1:] != moved[:-1]) | ~known[1:]
    changes = np.cumsum(changes, axis=0)
    start = np.ones_like(changes)
    start[w:] = changes[1: len(x) - w + 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, centre + s1 / n, np.nan)
        ss = s2 - s1 * s1 / n
        std = np.sqrt(np.maximum(ss, 0.0) / (n - 1))
    # equal values, or what is left of them after cancellation (a hole at the window's edge hides equality)
    std = np.where((changes == start) | (ss <= 1e-14 * s2), 0.0, std)
    return mean, np.where(n > 1, std, np.nan)


def standardised(x: np.ndarray, z_window: int, vol_window: int | None) -> np.ndarray:
    """The z-score against the ``z_window`` rows before each row, of values optionally divided by the
    deviation of their own relative changes. Missing to 0."""
    if vol_window is not None:
        change = np.zeros_like(x)
        with np.errstate(invalid="ignore", divide="ignore"):
            change[1:] = np.where((x[:-1] == 0) & (x[1:] == 0), 0.0, x[1:] / x[:-1] - 1.0)
        vol = _trailing(change, vol_window)[1]
        x = x / np.where(np.isnan(vol) | (vol == 0), 1.0, vol)
    mean, std = _trailing(x, z_window)
    out = np.zeros_like(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        out[1:] = np.where(std[:-1] == 0, np.nan, (x[1:] - mean[:-1]) / std[:-1])
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def standardise_columns(
    df: DataFrame,
    columns: list[str],
    z_window: int,
    vol_window: int | None,
    keys: tuple[str, ...],
    order: str,
    keep: list[str],
    newest_only: bool = False,
) -> DataFrame:
    """``keep`` plus standardised ``columns`` in one Arrow pass over bounded groups. Meant for wide tables:
    a hundred columns are one matrix here, but over a thousand window expressions as frames."""
    # positional names inside the pass: feature names may hold a dot
    inside = [*[(c, f"_k{i}") for i, c in enumerate(keep)], *[(c, f"_z{i}") for i, c in enumerate(columns)]]
    fed = df.select(*[F.col(f"`{c}`") for c in (*keys, order) if c not in keep], *[F.col(f"`{c}`").alias(n) for c, n in inside])
    names = {c: n for c, n in inside}
    group = [names.get(k, k) for k in keys]
    by = names.get(order, order)
    kept, scored = [names[c] for c in keep], [names[c] for c in columns]
    schema = T.StructType([fed.schema[n] for n in kept] + [T.StructField(n, T.DoubleType()) for n in scored])

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, kind="stable").reset_index(drop=True)
        z = standardised(pdf[scored].to_numpy(dtype="float64", na_value=np.nan), z_window, vol_window)
        out = pd.concat([pdf[kept], pd.DataFrame(z, columns=scored)], axis=1)
        return out.tail(1) if newest_only else out

    done = fed.groupBy(*group).applyInPandas(per_group, schema)
    return done.select(*[F.col(n).alias(c) for c, n in inside])


def run(df: DataFrame, todo: list[Kernel], keys: tuple[str, ...], order: tuple[str, ...], keep: list[str]) -> DataFrame:
    """``keep`` columns plus one double column per kernel."""
    inputs: dict[str, str] = {}
    for k in todo:
        for s in (k.series, k.other):
            if s is not None:
                inputs.setdefault(s.key, f"_in{len(inputs)}")
    columns = {s.key: s.sql for k in todo for s in (k.series, k.other) if s is not None}
    fed = df.selectExpr(
        *[f"`{c}`" for c in keep], *[f"CAST({columns[key]} AS DOUBLE) AS {name}" for key, name in inputs.items()]
    )
    plan = [(k.kind, k.name, inputs[k.series.key], k.w, k.params, inputs[k.other.key] if k.other is not None else None) for k in todo]
    order_by = list(order)
    schema = T.StructType(
        [fed.schema[c] for c in keep] + [T.StructField(k.name, T.DoubleType()) for k in todo]
    )

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_by, kind="stable")
        series = {c: pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in inputs.values()}
        values = {name: evaluate(kind, series[c], w, params, None if o is None else series[o]) for kind, name, c, w, params, o in plan}
        result = pdf[keep].reset_index(drop=True)
        return pd.concat([result, pd.DataFrame(values)], axis=1)

    out = fed.groupBy(*keys).applyInPandas(per_group, schema)
    # NaN is the kernel's "missing"; the library's is NULL.
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        *[F.nullif(F.col(k.name), F.lit(float("nan"))).alias(k.name) for k in todo],
    )
