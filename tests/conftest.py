import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores="8", memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_bars(n=300, seed=42, symbols=("AAA", "BBB"), scale=None):
    """Random-walk minute bars, all values at least 1."""
    frames = []
    for k, symbol in enumerate(symbols):
        rng = np.random.default_rng(seed + k)
        step = rng.normal(0, 1, n) * (scale if scale is not None else 1.0)
        close = np.maximum(100 + np.cumsum(step), 1)
        spread = np.abs(rng.normal(0, 0.5, (4, n)))
        vol = np.maximum(np.abs(rng.normal(1000, 300, n)), 1)
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "timestamp": pd.date_range("2021-01-01", periods=n, freq="min", tz="UTC"),
                    "open": np.maximum(close + spread[0] - 0.25, 1),
                    "high": np.maximum(close + spread[1], 1),
                    "low": np.maximum(close - spread[2], 1),
                    "close": close,
                    "volume": vol,
                    "quote_asset_volume": vol * close * (1 + spread[3] / 1000),
                    "number_of_trades": rng.integers(1, 500, n),
                    "taker_buy_base_vol": vol * 0.4,
                    "taker_buy_quote_vol": vol * close * 0.4,
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    out = pdf.copy()
    out["timestamp"] = out["timestamp"].dt.tz_convert(None) if out["timestamp"].dt.tz is not None else out["timestamp"]
    return spark.createDataFrame(out)
