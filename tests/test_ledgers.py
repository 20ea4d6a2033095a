import os

import pytest
from pyspark.sql import functions as F

from tickloom.plans import steps
from tickloom.schemas import ORDERS
from tickloom.sources import ledgers
from tests.conftest import make_bars, to_spark


def change(spark, rows, fields="id bigint, status string, retry_count int"):
    return spark.createDataFrame(rows, fields)


def stored(spark, path, ids=None):
    return sorted((r.id, r.status, r.retry_count) for r in ledgers.read_ledger(spark, path, ORDERS, ids).collect())


def put(spark, path, rows, writer="w", batch=None, fields="id bigint, status string, retry_count int"):
    return ledgers.append_changes(spark, path, change(spark, rows, fields), ORDERS, writer, batch, 4)


def test_changes_merge_field_by_field(spark, tmp_path):
    path = str(tmp_path / "orders")
    assert stored(spark, path) == []
    assert put(spark, path, [(1, "NEW", 0), (2, "NEW", 0)], batch=0) == 1
    assert put(spark, path, [(1, "ASSIGNED", None), (3, "NEW", 5)], batch=1) == 2
    assert put(spark, path, [(1, None, 4)], writer="other", batch=0) == 3
    want = [(1, "ASSIGNED", 4), (2, "NEW", 0), (3, "NEW", 5)]
    assert stored(spark, path) == want
    for _ in range(2):
        assert put(spark, path, [(1, "SETTLED", 9)], batch=1) is None
        assert stored(spark, path) == want
    assert stored(spark, path, [3, 1, 77]) == [want[0], want[2]]


def test_compaction_touches_only_changed_buckets(spark, tmp_path):
    path = str(tmp_path / "orders")
    assert ledgers.compact(spark, path, ORDERS) is None
    put(spark, path, [(i, "NEW", i) for i in range(40)], batch=0)
    before = stored(spark, path)
    ledgers.compact(spark, path, ORDERS)
    assert stored(spark, path) == before
    put(spark, path, [(7, "OPEN", None)], batch=1)
    ledgers.compact(spark, path, ORDERS)
    state = ledgers._state(ledgers.Folder(spark, path), 4)
    assert state["changes"] == [] and sorted({s for s, _ in state["snapshot"].values()}) == [2, 4]
    assert sum(s == 4 for s, _ in state["snapshot"].values()) == 1
    want = [(i, "OPEN" if i == 7 else "NEW", i) for i in range(40)]
    assert stored(spark, path) == want
    assert ledgers.vacuum(spark, path) == 2
    assert stored(spark, path) == want
    assert put(spark, path, [(1, "SETTLED", 9)], batch=1) is None  # the writers outlive compaction and clean-up


def test_a_lost_write_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "orders")
    put(spark, path, [(1, "NEW", 0)], batch=0)
    real = ledgers.Folder.create

    def lost(self, name, value):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(ledgers.Folder, "create", lost)
    with pytest.raises(RuntimeError):
        put(spark, path, [(1, "OPEN", 1)], batch=1)
    monkeypatch.setattr(ledgers.Folder, "create", real)
    assert stored(spark, path) == [(1, "NEW", 0)]
    assert put(spark, path, [(1, "OPEN", 1)], batch=1) == 2
    assert stored(spark, path) == [(1, "OPEN", 1)]
    assert ledgers.vacuum(spark, path) == 1


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "orders")
    put(spark, path, [(i, "NEW", i) for i in range(200)], batch=0)
    ledgers.compact(spark, path, ORDERS)
    found = ledgers.read_ledger(spark, path, ORDERS, [17])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "bucket" in plan and "PushedFilters: [" in plan
    assert len(found.inputFiles()) == 4  # listed; the partition filter leaves one
    files = [r.f for r in spark.read.parquet(os.path.join(path, "data", ledgers._state(ledgers.Folder(spark, path), 4)["snapshot"]["0"][1])).select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) == 4


def test_a_job_branches_and_names_its_results(spark, monkeypatch):
    bars = to_spark(spark, make_bars(30)).cache()
    runs = []
    monkeypatch.setattr(steps, "materialize", lambda df, label: runs.append(label) or df)
    config = {
        "default": "a",
        "jobs": {
            "a": {
                "steps": [
                    {"type": "time_range", "start": "2021-01-01 00:05", "end": "2021-01-01 00:20", "as": "cut"},
                    {"type": "previous_window_stats", "window": 3, "as": "stats"},
                    {"type": "number", "from": "cut", "as": "numbered"},
                    {"type": "number", "from": "input"},
                ]
            }
        },
    }
    made = steps.run_all(bars, config, steps.REGISTRY)
    assert made["cut"].count() == 32 and "close_mean" in made["stats"].columns and "close_mean" not in made["numbered"].columns
    assert made[steps.LAST].count() == 60 and set(made) == {"input", "cut", "stats", "numbered", ""}
    assert runs == ["job-cut"]  # taken twice; the others once at most
    for fault, place in (({"from": "gone"}, r"steps\.1\.from: 'gone'"), ({"as": "cut"}, r"steps\.1\.as: 'cut'"), ({"as": "input"}, r"\.as: 'input'"), ({"as": 3}, r"\.as: 3")):
        bad = {"default": "a", "jobs": {"a": {"steps": [config["jobs"]["a"]["steps"][0], {"type": "number", **fault}]}}}
        with pytest.raises(steps.ConfigError, match=place):
            steps.parse(bad, steps.REGISTRY)
