"""Sources, stores, configured jobs, scoring."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import make_bars, to_spark
from tickloom.functions.layout import Chunking
from tickloom.operators import scoring
from tickloom.plans import daily, steps
from tickloom.sources import bars as src
from tickloom.sources import records as rec
from tickloom.streaming import ingest

START = 1609459200000


def kline(i, price="100.5"):
    return [START + 60000 * i, price, "101", "99", "100", "12.5", START + 60000 * i + 59999, "1250", 7, "6", "600", "0"]


def raw(spark, rows):
    return spark.createDataFrame([("AAA", json.dumps(rows))], "symbol string, klines string")


def test_kline_types_and_repeats(spark):
    out = src.parse_klines(raw(spark, [kline(1), kline(0), kline(1)]))
    assert out.count() == 3 and "close_time" not in out.columns and "ignore" not in out.columns
    row = out.orderBy("timestamp").first()
    assert row.open == 100.5 and row.number_of_trades == 7
    assert out.select(F.unix_millis(F.min("timestamp"))).first()[0] == START
    assert src.parse_klines(raw(spark, [])).count() == 0


def test_bad_kline_raises_or_is_set_aside(spark):
    df = raw(spark, [kline(0), kline(1, "oops")])
    with pytest.raises(PySparkException):
        src.parse_klines(df).collect()
    good, bad = ingest.parse_stream(df)
    assert (good.count(), bad.count()) == (1, 1)


def _bars(spark, minutes):
    ts = pd.to_datetime([START + 60000 * m for m in minutes], unit="ms", utc=True)
    return to_spark(spark, pd.DataFrame({"symbol": "AAA", "timestamp": ts, "close": 1.0}))


@pytest.mark.parametrize(
    "minutes,want",
    [([0, 1, 2, 3, 4, 5], []), ([2, 3, 4, 5], [(0, 1)]), ([0, 1, 4, 5], [(2, 3)]), ([0, 1, 2], [(3, 5)]), ([1, 3, 4], [(0, 0), (2, 2), (5, 5)]), ([9, 10], [(0, 5)])],
)
def test_gaps(spark, minutes, want):
    gaps = src.missing_ranges(_bars(spark, minutes), "2021-01-01 00:00:00", "2021-01-01 00:05:30", 1, Chunking(2, 120))
    got = sorted(((F_ms(r.gap_start)), F_ms(r.gap_end)) for r in gaps.collect())
    assert got == want


def F_ms(ts):
    return int((pd.Timestamp(ts).tz_localize("UTC") - pd.Timestamp(START, unit="ms", tz="UTC")).total_seconds() // 60)


def test_interval_minutes(spark):
    df = spark.createDataFrame([("1h",), ("1M",), ("7x",)], "i string").select(src.interval_minutes(F.col("i")).alias("m"))
    assert [r.m for r in df.collect()] == [60, 43200, 1]


def test_upsert_days(spark, tmp_path):
    path = str(tmp_path / "klines")

    def rows(values, version):
        data = [("AAA", "1m", pd.Timestamp(START + 60000 * m, unit="ms").to_pydatetime(), v, version) for m, v in values]
        return spark.createDataFrame(data, "symbol string, interval string, timestamp timestamp, close double, ingest_ts int")

    src.upsert_days(spark, path, rows([(0, 1.0), (1, 1.0), (1500, 1.0)], 1))
    src.upsert_days(spark, path, rows([(1, 2.0), (2, 2.0)], 2))
    got = sorted((F_ms(r.timestamp), r.close) for r in spark.read.parquet(path).collect())
    assert got == [(0, 1.0), (1, 2.0), (2, 2.0), (1500, 1.0)]
    plan = src.stored_days(spark, path, [pd.Timestamp(START, unit="ms").date()])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "(dt" in plan


def test_reversed_range_is_empty(spark):
    assert src.time_range(_bars(spark, [0, 1]), "2021-01-02", "2021-01-01").count() == 0


@pytest.mark.parametrize("value,kind,want", [([1.0, 2.0], "array<double>", [[1.0, 2.0]]), ([[1.0], [2.0]], "array<array<double>>", [[1.0], [2.0]]),
                                              ([[[1.0], [2.0]]], "array<array<array<double>>>", [[1.0, 2.0]]), (3.0, "double", [[]]), (None, "array<double>", [[]])])
def test_feature_matrix(spark, value, kind, want):
    df = spark.createDataFrame([(value,)], f"f {kind}")
    out = df.select(rec.feature_matrix(df, "f").alias("m")).first().m
    if value is None:
        assert out in ([[]], [None])
    else:
        assert [list(r) for r in out] == want


def test_append_and_read(spark, tmp_path):
    from pyspark.sql import Observation

    path, seen = str(tmp_path / "store"), Observation()
    data = [("r1", datetime(2024, 1, 15, 10), "AAA", "ple", "[]", [1.0, 2.0], None), ("", datetime(2024, 1, 15), "AAA", "ple", "[]", [1.0], None)]
    df = spark.createDataFrame(data, "request_id string, timestamp timestamp, symbol string, model_name string, ohlcv_data string, features array<double>, model_output string")
    rec.append_records(rec.to_records(df, F.lit("2024-02-01 00:00:05").cast("timestamp")), path, seen)
    m = rec.write_metrics(seen.get)
    assert (m["queued"], m["written"], m["dropped"], m["success_rate"]) == (2, 1, 1, 0.5)
    row = rec.read_records(spark, path).first()
    assert str(row.dt) == "2024-02-01" and row.model_output == "null" and row.features == [[1.0, 2.0]]


def test_file_dates(spark):
    ok = spark.createDataFrame([("features_20250115_101010_123_AB.h5",)], "p string")
    assert str(ok.select(rec.date_of_file(F.col("p"))).first()[0]) == "2025-01-15"
    with pytest.raises(PySparkException):
        spark.createDataFrame([("other.h5",)], "p string").select(rec.date_of_file(F.col("p"))).collect()


def _day_records(spark, n, symbols=("AAA", "BBB")):
    rows = []
    for s in symbols:
        for i in range(n):
            body = json.dumps({"open": 1000 + i, "high": 1001 + i, "low": 999 + i, "close": 1000 + i, "volume": 100 + i})
            rows.append((f"{s}{i}", datetime(2024, 1, 15) + timedelta(minutes=i), s, "m", body, [0.0], "{}"))
    return spark.createDataFrame(rows, "request_id string, timestamp timestamp, symbol string, model_name string, ohlcv_data string, features array<double>, model_output string")


def test_daily_run(spark, tmp_path):
    store, out = str(tmp_path / "s"), str(tmp_path / "o")
    r = _day_records(spark, 1440).unionByName(_day_records(spark, 1000, ("CCC",)))
    rec.append_records(rec.to_records(r, F.col("timestamp")), store)
    rep = {x.symbol: (x.rows, x.low, x.status) for x in daily.run_day(spark, store, out, "2024-01-15").collect()}
    assert rep == {"AAA": (1440, False, "processed"), "BBB": (1440, False, "processed"), "CCC": (1000, True, "processed")}
    pdf = spark.read.parquet(out).filter("symbol = 'AAA'").toPandas().sort_values("timestamp").reset_index(drop=True)
    assert pdf.close_mean[:60].isna().all() and abs(pdf.close_mean[60] - (1000 + np.arange(60)).mean()) < 1e-9


def test_steps_configuration(spark):
    df = to_spark(spark, make_bars(90))
    config = {
        "default": "a", "methods": {"process_1": "b"},
        "jobs": {"a": {"steps": [{"type": "previous_window_stats", "window": 10}]}, "b": {"steps": [{"type": "time_range", "start": "2021-01-01", "end": "2021-01-01 00:09"}]}},
    }
    plan = steps.parse(config, steps.REGISTRY)
    assert steps.choose(plan, "b", None) == "b" and steps.choose(plan, None, "process_1") == "b"
    assert steps.choose(plan, "a", "process_1") == "a" and steps.choose(plan) == "a"
    assert steps.run(df, config, steps.REGISTRY, method="process_1").count() == 20
    for bad, place in [
        ([], r"\$: want dict"),
        ({**config, "default": "z"}, r"\$.default: 'z'"),
        ({**config, "methods": {"m": "z"}}, r"\$.methods.m: 'z'"),
        ({**config, "jobs": {"a": {"steps": []}, "b": config["jobs"]["b"]}}, r"jobs.a.steps: empty"),
        ({**config, "jobs": {"a": {"steps": [{"type": "nope"}]}, "b": config["jobs"]["b"]}}, r"jobs.a.steps.0: no step"),
        ({**config, "jobs": {"a": {"steps": [{"type": "time_range", "begin": 1}]}, "b": 3}}, r"steps.0: .*jobs.b: want dict"),
    ]:
        with pytest.raises(steps.ConfigError, match=place):
            steps.parse(bad, steps.REGISTRY)
    with pytest.raises(steps.ConfigError):
        steps.choose(plan, "gone")
    with pytest.raises(steps.ConfigError):
        steps.run(df.drop("close"), config, steps.REGISTRY)


@pytest.mark.parametrize("model", ["ple", "dragonnet"])
def test_scoring(spark, tmp_path, model):
    w = scoring.seeded_weights(model, 12)
    scoring.save_weights(spark, w, str(tmp_path / "w"))
    loaded = scoring.load_weights(spark, str(tmp_path / "w"))
    x = np.random.default_rng(1).normal(size=(5, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>")
    got = scoring.score(df, model, loaded).toPandas().sort_values("id")
    forward, names = scoring.MODELS[model]
    for name, v in zip(names, forward(x, w)):
        want = 1 / (1 + np.exp(-v)) if name.startswith("t_") else v
        np.testing.assert_allclose(got[name], want, rtol=1e-9)
    assert len(names) == (6 if model == "ple" else 5)


def test_clean_up_removes_what_was_written(spark):
    from tickloom.session import clean_up, materialize

    clean_up(spark)
    kept = materialize(spark.range(3), "clean-up-test")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert src.path_exists(spark, path)
    assert clean_up(spark) == 1 and not src.path_exists(spark, path)
