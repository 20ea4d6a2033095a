"""The chunk layout must not be visible in results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import make_bars, to_spark
from tickloom.functions import rolling
from tickloom.functions.layout import Chunking, chunked, tail_rows
from tickloom.operators import alphas, columns, features

SMALL = {
    "alpha006": [10], "alpha007": [12], "alpha009": [3], "alpha013": [5], "alpha014": [1], "alpha021": [4], "alpha024": [1],
    "alpha026": [2], "alpha035": [8], "alpha043": [2], "alpha084": [2], "alpha102": [14], "alpha104": [[5, 12]], "alpha111": [40],
    "alpha115": [40], "alpha117": [70], "alpha119": [None], "alpha121": [None], "alpha127": [16], "alpha131": [[24, 1]],
}


@pytest.fixture(scope="module")
def bars(spark):
    pdf = make_bars(700)
    pdf = pd.concat([pdf[pdf.symbol == "AAA"], pdf[pdf.symbol == "BBB"].head(90)])
    return to_spark(spark, pdf).cache()


def collect(df):
    return df.toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)


@pytest.mark.parametrize("rows,seconds", [(100, 600), (37, 1200), (5000, 3600)])
def test_chunks_hold_their_halo(bars, rows, seconds):
    out = collect(chunked(bars, 25, Chunking(rows, seconds)))
    own = out[~out._halo]
    assert len(own) == bars.count()
    for (symbol, _), g in out.groupby(["symbol", "_chunk"]):
        kept = g[~g._halo]
        if len(kept):
            before = own[(own.symbol == symbol) & (own.timestamp < kept.timestamp.min())]
            assert (g[g._halo].timestamp < kept.timestamp.min()).sum() >= min(25, len(before))


@pytest.mark.parametrize("rows,seconds", [(150, 1200), (64, 600)])
def test_features_do_not_depend_on_chunks(bars, rows, seconds):
    whole = collect(alphas.compute(bars, SMALL, None))
    cut = collect(alphas.compute(bars, SMALL, Chunking(rows, seconds)))
    assert list(whole.columns) == list(cut.columns)
    for c in whole.columns[2:]:
        a, b = whole[c].to_numpy(float), cut[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-7, err_msg=c)


def test_arrays_and_frames_agree(bars):
    config = alphas.DEFAULT_CONFIG | SMALL | {"alpha028": [5], "alpha053": [4], "alpha109": [12], "alpha116": [8], "alpha118": [6], "alpha126": [6], "alpha130": [16]}
    config = {k: ([v[0]] if k not in SMALL else v) for k, v in config.items()}
    frames = collect(alphas.compute(bars, config, Chunking(150, 1200)))
    at_once = collect(alphas.compute(bars, config, Chunking(150, 1200), arrays=True))
    assert list(frames.columns) == list(at_once.columns)
    for c in frames.columns[2:]:
        np.testing.assert_allclose(frames[c].to_numpy(float), at_once[c].to_numpy(float), rtol=1e-7, atol=1e-7, err_msg=c)


def test_z_scores_do_not_depend_on_chunks_or_width(bars):
    df = bars.select("symbol", "timestamp", "close", "volume")
    whole = collect(features.rolling_z_score_vol(df, 30, 100, chunking=None))
    cut = collect(features.rolling_z_score_vol(df, 30, 100, chunking=Chunking(64, 600)))
    many = df.select("*", *[(F.col("close") * i).alias(f"c{i}") for i in range(2, 22)])
    wide = collect(features.rolling_z_score_vol(many, 30, 100, chunking=Chunking(64, 600)))
    for c in ("close", "volume"):
        np.testing.assert_allclose(whole[c], cut[c], rtol=1e-7, atol=1e-7)
        np.testing.assert_allclose(whole[c], wide[c], rtol=1e-7, atol=1e-7)


def test_holes_are_filled_across_chunks(spark, bars):
    holed = bars.withColumn("x", F.when(F.minute("timestamp") == 7, F.col("close"))).select("symbol", "timestamp", "x")
    a = collect(columns.decay_linear(holed, "x", 5))
    b = collect(columns.decay_linear(holed, "x", 5, chunking=Chunking(20, 300)))
    np.testing.assert_allclose(a.decayed, b.decayed)


def test_tail_rows(bars):
    out = collect(tail_rows(bars, 120, Chunking(50, 600)))
    want = bars.toPandas().sort_values(["symbol", "timestamp"]).groupby("symbol").tail(120).reset_index(drop=True)
    assert (out.timestamp.values == want.timestamp.values).all()


def test_repeated_times_stay(spark):
    pdf = pd.concat([make_bars(40, symbols=("AAA",))] * 2)
    assert chunked(to_spark(spark, pdf), 0, Chunking(10, 300)).count() == 80


@pytest.mark.parametrize("w", [20, 40, 200])
def test_windows_forget_outliers(spark, w):
    """A huge value leaves no trace once it has left the window, by frames and by the Arrow pass alike."""
    pdf = make_bars(900, symbols=("AAA",))
    pdf.loc[[0, 300, 601], "volume"] = 1e16
    r = rolling.Rolling()
    c, v = r.source("close"), r.source("volume")
    out = {"sum": r.sum(v, w), "mean": r.mean(v, w), "std": r.std(v, w), "corr": r.corr(c, v, w), "cov": r.cov(v, c, w), "skew": r.skew(v, w), "deep": r.corr(r.mean(v, w), c, w), "vol": r.spread(v, w)}
    laid = chunked(to_spark(spark, pdf), rolling.lookback(out), Chunking(250, 600))
    got = collect(r.select(laid, out, keep=("symbol", "timestamp", "_halo")).filter("not _halo"))
    x, y = pdf["volume"], pdf["close"]
    roll = lambda s, f: pd.Series([getattr(s[max(0, i - w + 1) : i + 1], f)() if i >= w - 1 else np.nan for i in range(len(s))])
    two = lambda a, b, f: pd.Series([getattr(a[i - w + 1 : i + 1], f)(b[i - w + 1 : i + 1]) if i >= w - 1 else np.nan for i in range(len(a))])
    calm = (x < 1e10).rolling(2 * w).min() == 1
    want = {"sum": roll(x, "sum"), "mean": roll(x, "mean"), "std": roll(x, "std"), "corr": two(y, x, "corr"), "cov": two(x, y, "cov"), "skew": roll(x, "skew"), "vol": roll(x, "std")}
    want["deep"] = two(want["mean"], y, "corr")
    for name, values in want.items():
        np.testing.assert_allclose(got[name][calm], values[calm], rtol=1e-9, atol=1e-9, err_msg=name)


def test_positions_over_many_tasks(spark):
    from tickloom.operators.columns import positions

    rows = [(k, float(v), v % 3 + 1) for k in ("a", None, "b") for v in range(50)]
    df = spark.createDataFrame(rows, "k string, v double, n int").repartition(5)
    want = sorted(((k or "", v, n, sum(m for j, w, m in rows if j == k and w < v)) for k, v, n in rows))
    for size in (7, 1000):
        got = positions(df, ["k"], "v", ["n"], size).collect()
        assert sorted((r.k or "", r.v, r.n, r.n_before) for r in got) == want


@pytest.mark.parametrize("w", [2, 7, 60])
@pytest.mark.parametrize("kind", ["rank", "share_below", "product"])
def test_order_statistics_by_counts(monkeypatch, w, kind):
    from tickloom.functions import kernels

    rng = np.random.default_rng(w)
    x = rng.normal(size=400).round(1)
    x[[0, 90, 91, 250]] = np.nan
    x[300:340] = 0.5
    monkeypatch.setattr(kernels, "DIRECT_RANKS", 0)
    got = kernels.evaluate(kind, x, w)
    for i in range(len(x)):
        window = x[i - w + 1 : i + 1]
        if i < w - 1 or np.isnan(window).any():
            assert np.isnan(got[i])
        elif kind == "product":
            assert abs(got[i] - window.prod()) <= 1e-12 * abs(window.prod())
        elif kind == "rank":
            assert got[i] == (window < window[-1]).sum() + ((window == window[-1]).sum() + 1) / 2
        else:
            assert got[i] == (window[:-1] < window[-1]).sum() / (w - 1)
