"""Feature values against pandas, and the served job's properties."""

import numpy as np
import pandas as pd
import pytest

from tests.conftest import make_bars, to_spark
from tickloom.functions import kernels
from tickloom.functions.layout import Chunking
from tickloom.operators import alphas, features


@pytest.fixture(scope="module")
def pdf():
    return make_bars(600, symbols=("AAA",))


@pytest.fixture(scope="module")
def built(spark, pdf):
    config = {
        "alpha007": [60], "alpha009": [30], "alpha014": [2], "alpha028": [30], "alpha035": [60], "alpha084": [4], "alpha102": [60],
        "alpha108": [60], "alpha111": [60], "alpha112": [20, 60], "alpha119": [None], "alpha127": [60], "alpha128": [60],
        "alpha129": [[60, 0.00556]], "alpha130": [60],
    }
    return alphas.compute(to_spark(spark, pdf), config, Chunking()).toPandas().sort_values("timestamp").reset_index(drop=True)


def rank_of_last(x):
    return (x < x[-1]).sum() + ((x == x[-1]).sum() + 1) / 2


def check(built, name, want, rtol=1e-6):
    np.testing.assert_allclose(built[name].to_numpy(float), np.asarray(want, float), rtol=rtol, atol=1e-7, err_msg=name)


def test_price_features_match_pandas(built, pdf):
    c, v = pdf.close, pdf.volume
    vwap = pdf.quote_asset_volume / v
    returns = c.pct_change().fillna(0)
    d = c.diff(30)
    want = (-d).where(~((d.rolling(150).min() > 0) | (d.rolling(150).max() < 0)), d)
    check(built, "alpha009_30_new", want)
    check(built, "alpha014_2_new", vwap.rolling(460).corr(c.shift(10)), 1e-5)
    co = v.rolling(120).mean().rolling(30).corr(pdf.low).fillna(0)
    check(built, "alpha028_30_new", co + (pdf.high + pdf.low) / 2 - c)
    up, down = c.diff().clip(lower=0).rolling(60).mean(), (-c.diff().clip(upper=0)).rolling(60).mean()
    check(built, "alpha102_60_new", 1 - 1 / (1 + up / down))
    check(built, "alpha108_60_new", c.pct_change().rolling(60).std())
    check(built, "alpha111_60_new", returns.rolling(60).skew().fillna(0), 1e-5)
    for w in (20, 60):
        m, s = c.rolling(w).mean(), c.rolling(w).std()
        check(built, f"alpha112_{w}_new", ((c - (m - 2 * s)) / (4 * s)).fillna(0))


def test_rank_features_match_pandas(built, pdf):
    c, v = pdf.close, pdf.volume
    vwap = pdf.quote_asset_volume / v
    returns = c.pct_change().fillna(0)

    def rank(x, w):
        return x.rolling(w).apply(rank_of_last, raw=True)

    d = c.diff(20)
    a7 = (-rank(d.abs(), 60) * np.sign(d)).where(~(v.rolling(60).mean() >= v), -1)
    check(built, "alpha007_60_new", a7)
    check(built, "alpha035_60_new", rank(v, 120) * (1 - rank(c + pdf.high - pdf.low, 60)) * (1 - rank(returns, 120)))
    check(built, "alpha084_4_new", rank(vwap - vwap.rolling(60).max(), 84) ** (c.diff(20) / 1000))


def test_spectral_features_match_numpy(built, pdf):
    def power(x):
        return np.abs(np.fft.fft(x))[: len(x) // 2]

    def slope(x):
        f, p = np.fft.fftfreq(60)[1:30], power(x)[1:]
        return -np.polyfit(np.log(f), np.log(p), 1)[0]

    def share(x):
        p = power(x)
        return p[np.fft.fftfreq(60)[:30] > 0.00556].sum() / p.sum()

    def entropy(x):
        p = power(x) / power(x).sum()
        return -(p * np.log(p)).sum() / np.log(30)

    roll = pdf.close.rolling(60)
    check(built, "alpha127_60_new", roll.apply(lambda x: (np.argmax(power(x)[1:]) + 1) / 60, raw=True))
    check(built, "alpha128_60_new", roll.apply(slope, raw=True))
    check(built, "alpha129_60_0.00556_new", roll.apply(share, raw=True))
    check(built, "alpha130_60_new", roll.apply(entropy, raw=True))


def test_streak(built, pdf):
    want, run = [], 0
    prev = None
    for s in np.sign(pdf.close.pct_change().fillna(0)):
        run = run + 1 if s == prev else 1
        prev = s
        want.append(run * s)
    check(built, "alpha119_new", want)


def test_wavelet_filters():
    low, high = np.array(kernels.DB4_LOW), np.array(kernels.db4_high())
    assert abs(low.sum() - np.sqrt(2)) < 1e-9 and abs(high.sum()) < 1e-9
    assert abs(low @ high) < 1e-12 and abs((low**2).sum() - 1) < 1e-9
    assert abs(kernels.detail_means(60, 1).sum()) < 1e-9  # a constant has no detail


@pytest.mark.parametrize("w", [1, 2, 7, 50, 400, 900])
def test_trailing_moments(w):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[100, 0], x[7, 2], x[50:200, 1] = 1e16, np.nan, 3.0
    mean, std = kernels._trailing(x, w)
    for j in range(3):
        slices = [pd.Series(x[max(0, i - w + 1): i + 1, j]) for i in range(400)]
        np.testing.assert_allclose(mean[:, j], [s.mean() for s in slices], rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(std[:, j], [s.std() for s in slices], rtol=1e-7, atol=1e-9)


def test_default_set_is_100_features_and_111_columns(spark, pdf):
    assert len(alphas.tasks(alphas.DEFAULT_CONFIG)) == 100
    assert len(alphas.tasks(alphas.SHORT_CONFIG)) == 143
    out = alphas.compute(to_spark(spark, pdf))
    assert len([c for c in out.columns if c not in ("symbol", "timestamp")]) == 111


def test_configuration_rules(spark, pdf, tmp_path):
    df = to_spark(spark, pdf)
    out = alphas.compute(df, {"alpha006": [60], "alpha999": [1]})
    assert "alpha006_60_new" in out.columns and not any("999" in c for c in out.columns)
    assert alphas.compute(df, {}).columns == [*df.columns, "vwap", "returns"]
    with pytest.raises(FileNotFoundError):
        alphas.load_config(str(tmp_path / "none.json"))


SMALL = {"alpha012": [3], "alpha041": [None], "alpha103": [6]}


@pytest.mark.parametrize("width", [0, -3, 5, 14, 40])
def test_width_always_equals_target(spark, pdf, width):
    row = features.feature_vectors(to_spark(spark, pdf), width, config=SMALL).first()
    assert len(row.features) == max(width, 0)
    assert np.isfinite(row.features).all()


def test_same_input_same_output(spark, pdf):
    df = to_spark(spark, pdf)
    a, b = (features.feature_vectors(df, 14, config=SMALL).first().features for _ in range(2))
    assert a == b


def test_most_scores_are_small(spark, pdf):
    v = np.array(features.feature_vectors(to_spark(spark, make_bars(300, 999, ("AAA",))), 111).first().features)
    assert len(v) == 111 and (np.abs(v) < 10).mean() >= 0.8


def test_constant_stretch(spark):
    pdf = make_bars(300, 5, ("AAA",))
    pdf.loc[:49, "volume"] = 1000.0
    z = features.rolling_z_score_vol(to_spark(spark, pdf), 120, 50000).toPandas()
    assert np.isfinite(z.drop(columns=["symbol", "timestamp"]).to_numpy(float)).all()


def test_previous_window_starts_at_60(spark, pdf):
    out = features.previous_window_stats(to_spark(spark, pdf)).toPandas().sort_values("timestamp").reset_index(drop=True)
    assert out.close_mean[:60].isna().all() and out.close_mean[60:].notna().all()
    assert abs(out.close_mean[60] - pdf.close[:60].mean()) < 1e-9
    assert abs(out.close_std[60] - pdf.close[:60].std()) < 1e-9
