import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.sources import bars as src
from tickloom.sources import commits
from tickloom.streaming import ingest

START = pd.Timestamp("2021-01-01 23:00")


def rows(spark, values, extra=()):
    data = [("AAA", "1m", (START + pd.Timedelta(minutes=r[0])).to_pydatetime(), *r[1:]) for r in values]
    return spark.createDataFrame(data, ", ".join(["symbol string, interval string, timestamp timestamp, close double", *extra]))


def stored(spark, path):
    found = spark.read.parquet(path).select((F.col("timestamp").cast("long") - int(START.timestamp())).alias("s"), "close", "ingest_ts").collect()
    return sorted((r.s // 60, r.close, r.ingest_ts) for r in found)


def log(path):
    return sorted(n for n in os.listdir(os.path.join(path, "_commits")) if not n.startswith("."))


def test_writers_share_one_sequence_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert commits.commit_bars(spark, path, rows(spark, [(0, 1.0), (90, 1.0)]), "first", 0) == 1
    assert commits.commit_bars(spark, path, rows(spark, [(0, 2.0)]), "first", 1) == 2
    assert commits.commit_bars(spark, path, rows(spark, [(0, 99.0), (5, 5.0)]), "second", 0) == 3  # a new stream starts at 0
    want = [(0, 99.0, 3), (5, 5.0, 3), (90, 1.0, 1)]
    assert stored(spark, path) == want
    for writer, batch in (("first", 0), ("first", 1), ("second", 0)):
        assert commits.commit_bars(spark, path, rows(spark, [(0, -1.0)]), writer, batch) is None
    assert stored(spark, path) == want
    assert commits.commit_bars(spark, path, rows(spark, []), "second", 1) == 4  # an empty batch counts
    assert commits.commit_bars(spark, path, rows(spark, [(0, 7.0)]), "job") == 5
    assert stored(spark, path)[0] == (0, 7.0, 5)


def test_repeats_inside_a_batch(spark, tmp_path):
    path = str(tmp_path / "bars")
    batch = rows(spark, [(0, 9.0, 1), (0, 3.0, 2), (1, 4.0, None), (1, 5.0, None)], ["arrival int"])
    commits.commit_bars(spark, path, batch.repartition(4), "w", 0, ("arrival",))
    assert stored(spark, path) == [(0, 3.0, 1), (1, 5.0, 1)]
    assert "arrival" not in spark.read.parquet(path).columns


@pytest.mark.parametrize("lost_at", ["before days", "after days"])
def test_a_lost_writer_is_finished_by_the_next(spark, tmp_path, monkeypatch, lost_at):
    path = str(tmp_path / "bars")
    commits.commit_bars(spark, path, rows(spark, [(0, 1.0), (90, 1.0)]), "w", 0)
    real = commits.write_days

    def lost(df, where):
        if lost_at == "after days":
            real(df, where)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(commits, "write_days", lost)
    with pytest.raises(RuntimeError):
        commits.commit_bars(spark, path, rows(spark, [(0, 2.0), (91, 2.0)]), "w", 1)
    monkeypatch.setattr(commits, "write_days", real)
    assert f"{2:020d}.pending.json" in log(path)
    assert commits.commit_bars(spark, path, rows(spark, [(0, 50.0)]), "w", 1) is None  # finished, not done again
    assert stored(spark, path) == [(0, 2.0, 2), (90, 1.0, 1), (91, 2.0, 2)]
    assert log(path) == [f"{n:020d}.json" for n in (1, 2)]


def test_notes_cut_off_while_written(spark, tmp_path):
    path = str(tmp_path / "bars")
    commits.commit_bars(spark, path, rows(spark, [(0, 1.0)]), "w", 0)
    for name, text in ((f"{2:020d}.pending.json", '{"sequ'), (f"{2:020d}.json", "")):
        with open(os.path.join(path, "_commits", name), "w") as f:
            f.write(text)
    assert commits.recover(spark, path) == {"sequence": 1, "writers": {"w": 0}}
    assert commits.commit_bars(spark, path, rows(spark, [(0, 2.0)]), "w", 1) == 2
    assert stored(spark, path) == [(0, 2.0, 2)]


def test_two_writers_of_one_sequence_collide(spark, tmp_path):
    path = str(tmp_path / "bars")
    commits.commit_bars(spark, path, rows(spark, [(0, 1.0)]), "w", 0)
    folder = commits.Folder(spark, path)
    folder.create("x.json.tmp", {"a": 1})
    with pytest.raises(Exception, match="exists"):
        folder.create("x.json.tmp", {"a": 2})


def test_the_log_stays_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "KEEP", 2)
    path = str(tmp_path / "bars")
    for n in range(5):
        commits.commit_bars(spark, path, rows(spark, [(0, float(n))]), "w", n)
    assert log(path) == [f"{n:020d}.json" for n in (4, 5)]
    with open(os.path.join(path, "_commits", log(path)[-1])) as f:
        assert json.load(f) == {"sequence": 5, "writers": {"w": 4}}


def test_a_new_checkpoint_goes_on_after_the_old_one(spark, tmp_path):
    path, inbox = str(tmp_path / "bars"), str(tmp_path / "inbox")

    def feed(values, checkpoint):
        made = rows(spark, values)
        made.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(made.schema).parquet(inbox)
        ingest.upsert_stream(ingest.clean_stream(stream), path, str(tmp_path / checkpoint)).awaitTermination()

    for n in range(3):
        feed([(0, float(n))], "one")
    assert stored(spark, path) == [(0, 2.0, 3)]
    inbox = str(tmp_path / "other")
    feed([(0, 99.0), (1, None)], "two")
    assert stored(spark, path) == [(0, 99.0, 4), (1, None, 4)]
    assert src.path_exists(spark, path)
