import datetime
import os

import pytest
from pyspark.sql import functions as F

from tickloom.functions.layout import Chunking
from tickloom.plans import daily
from tickloom.sources import bars as src
from tickloom.sources import lookups

START = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "store")
    rows = spark.range(40_000).select(
        F.md5(F.col("id").cast("string")).alias("request_id"), F.col("id").alias("seq"),
        (F.lit(START) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("timestamp"),
        F.rpad(F.sha2(F.col("id").cast("string"), 512), 400, "x").alias("payload"),
    )
    lookups.write_lookup_store(rows.withColumn("dt", F.to_date("timestamp")).coalesce(1), path, ndv=2_000, block_bytes=1 << 17)
    return path


def test_days_come_from_folders(spark, store):
    days = lookups.days_of(spark, store)
    assert len(days) == 28 and days[0] == "2024-03-28" and days == sorted(days, reverse=True)


@pytest.mark.parametrize("by,day_first,read", [("timestamp", True, 1), ("timestamp", False, 1), ("seq", False, 1)])
def test_newest_rows_read_few_days(spark, store, by, day_first, read):
    found, steps = lookups.newest_first(spark, store, 50, by, day_first=day_first)
    assert [r.seq for r in found.collect()] == list(range(39_999, 39_949, -1))
    assert sum(map(len, steps)) == read
    many, steps = lookups.newest_first(spark, store, 6_000, by, day_first=day_first)
    assert many.count() == 6_000 and many.agg(F.min("seq")).first()[0] == 34_000 and sum(map(len, steps)) <= 7
    everything, _ = lookups.newest_first(spark, store, 100_000, by, day_first=day_first)
    assert everything.count() == 40_000


def test_a_number_that_does_not_follow_the_days(spark, store):
    back = spark.read.parquet(store).withColumn("seq", 40_000 - F.col("seq"))
    path = store + "-reversed"
    back.repartition("dt").write.partitionBy("dt").parquet(path)
    found, steps = lookups.newest_first(spark, path, 10, "seq")
    assert [r.seq for r in found.collect()] == list(range(40_000, 39_990, -1)) and steps == [["2024-03-01"]]


def test_a_lookup_skips_row_groups(spark, store):
    wanted = spark.read.parquet(store).where("seq = 12345").first()["request_id"]
    hit = spark.read.parquet(store).where(F.col("request_id") == wanted)
    assert lookups.rows_read(hit) < 40_000 / 8
    miss = spark.read.parquet(store).where(F.col("request_id") == "0" * 32)
    assert lookups.rows_read(miss) < 40_000 / 8
    assert lookups.rows_read(spark.read.parquet(store)) == 40_000


def test_counts_read_no_column(spark, store):
    found = {str(r["dt"]): tuple(r)[1:] for r in lookups.footer_counts(spark, store, low=("seq",), high=("seq",)).collect()}
    assert found["2024-03-01"] == (1440, 0, 1439) and sum(v[0] for v in found.values()) == 40_000
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = session.read.parquet(store).groupBy("dt").agg(F.count(F.lit(1)), F.max("seq"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MAX(seq)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_removal_from_the_bar_store(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [(s, "1m", START + datetime.timedelta(minutes=m), float(m)) for s in ("A", "B") for m in range(0, 4 * 1440, 60)] + [("C", "1m", START + datetime.timedelta(days=1), 0.0)]
    src.write_days(spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp, close double"), path)
    assert src.stored_bytes(spark, path).first()["files"] == len([f for _, _, n in os.walk(path) for f in n if f.endswith(".parquet")])
    gone, late = src.remove_expired(spark, path, "2024-03-04 12:00:00", 2 * 1440)
    assert (gone, late) == (2, 25)
    back = spark.read.parquet(path)
    assert back.agg(F.min("timestamp")).first()[0] == datetime.datetime(2024, 3, 2, 12) and back.where("symbol = 'C'").count() == 0
    assert back.count() == 2 * 60
    src.clear_store(spark, path, "A")
    assert [r.symbol for r in spark.read.parquet(path).select("symbol").distinct().collect()] == ["B"]
    src.clear_store(spark, path)
    assert not src.path_exists(spark, path)


def test_late_rows_of_a_part_are_counted(spark, tmp_path):
    def records(minutes):
        rows = [(f"r{m}", START + datetime.timedelta(minutes=m), "A", f'{{"open":{m},"high":{m},"low":{m},"close":{m},"volume":1}}') for m in minutes]
        return spark.createDataFrame(rows, "request_id string, timestamp timestamp, symbol string, ohlcv_data string")

    out = str(tmp_path / "parts")
    assert daily.run_part(spark, records(range(0, 10)), out, "w", 0, 3, Chunking(4, 300)).first()["rows"] == 10
    assert daily.run_part(spark, records([5, 10, 11]), out, "w", 1, 3, Chunking(4, 300)).first().asDict()["late"] == 1
    assert daily.run_part(spark, records([50]), out, "w", 1, 3) is None
    got = sorted((r.close, r.close_mean) for r in daily.read_parts(spark, out).collect())
    assert got == [(float(m), None if m < 3 else m - 2.0) for m in range(12)]
