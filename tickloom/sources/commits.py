"""A commit log beside a bar table: versions that outlive a stream, and writes that are finished after a failure.

The log is the folder ``_commits`` of the table (readers skip it). ``<sequence>.json`` says what is stored: the highest
sequence and, per writer, its last batch. ``<sequence>.pending.json`` says that a write has begun: its merged days lie
complete beside it. Whoever writes next finishes such a write first, so a driver that is lost while it replaces days costs
nothing, and a batch that comes again is known by its writer and number and changes nothing. One writer works on a
table at a time; two that start the same sequence collide on creating its pending file, and the later one fails.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import materialize
from tickloom.sources.bars import path_exists, stored_days, upsert_latest, write_days

LOG = "_commits"
KEYS = ("symbol", "interval", "timestamp")
VERSION = "ingest_ts"
KEEP = 10  # states left in the log


class Folder:
    """Small files of the log, through the file system that Spark reads the table with."""

    def __init__(self, spark: SparkSession, path: str, name: str = LOG):
        self.jvm, self.path = spark._jvm, os.path.join(path, name)
        at = self.at("")
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, name) if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(""))) if self.fs.exists(self.at("")) else []

    def read(self, name: str) -> dict | None:
        """None for a file that was cut off while it was written."""
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> None:
        """Fails if the file exists."""
        stream = self.fs.create(self.at(name), False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def latest_state(folder: Folder) -> dict:
    for name in reversed([n for n in folder.names() if n.endswith(".json") and ".pending." not in n]):
        found = folder.read(name)
        if found:
            return found
    return {"sequence": 0, "writers": {}}


def _finish(spark: SparkSession, path: str, folder: Folder, state: dict, pending: dict) -> dict:
    """Replace the touched days by the merged ones and note the commit; doing it twice gives the same."""
    name = f"{pending['sequence']:020d}"
    merged = folder.at(f"{name}.days").toString()
    if pending["days"]:
        write_days(spark.read.parquet(merged), path)
    writers = state["writers"] | {pending["writer"]: pending["batch"]}
    state = {"sequence": pending["sequence"], "writers": writers}
    folder.remove(f"{name}.json")  # a cut-off note of the same sequence
    folder.create(f"{name}.json", state)
    folder.remove(f"{name}.pending.json")
    for old in folder.names():
        stale = old.endswith(".days") or (old.endswith(".json") and int(old.split(".")[0]) <= state["sequence"] - KEEP)
        if stale and int(old.split(".")[0]) <= state["sequence"]:
            folder.remove(old)
    return state


def recover(spark: SparkSession, path: str) -> dict:
    """Finish what a lost writer has begun; the state of the table: its last sequence and every writer's last batch."""
    folder = Folder(spark, path)
    state = latest_state(folder)
    for name in folder.names():
        if name.endswith(".pending.json"):
            pending = folder.read(name)
            if pending is None or pending["sequence"] <= state["sequence"]:
                folder.remove(name)  # nothing was replaced yet, or all was
            else:
                state = _finish(spark, path, folder, state, pending)
    return state


def newest_in_batch(incoming: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row of each bar: the last by ``order``; of equals the greatest by its values, so that the same rows in
    another arrangement give the same bar."""
    rest = [c for c in incoming.columns if c not in KEYS and c not in order]
    place = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    kept = incoming.groupBy(*KEYS).agg(F.max(place).alias("_row"))
    return kept.select(*KEYS, *[F.col(f"_row.{c}").alias(c) for c in rest])


def commit_bars(spark: SparkSession, path: str, incoming: DataFrame, writer: str, batch: int | None = None, order: tuple[str, ...] = ()) -> int | None:
    """Upsert bars as the table's next sequence: they win over everything stored, whoever stored it. ``batch`` numbers
    the writes of a writer: one that is stored already is left out (None is returned). Without a number every call
    is a write of its own. ``order`` names columns that order repeated bars inside the batch; they are not stored."""
    state = recover(spark, path)
    last = state["writers"].get(writer)
    if batch is not None and last is not None and batch <= last:
        return None
    sequence = state["sequence"] + 1
    folder, name = Folder(spark, path), f"{sequence:020d}"
    new = materialize(newest_in_batch(incoming, order).withColumn(VERSION, F.lit(sequence).cast("long")), "incoming")
    touched = new.select("symbol", "interval", F.to_date("timestamp").alias("dt")).distinct()
    days = [r["dt"] for r in touched.select("dt").distinct().collect()]  # one date per day in the batch
    if days:
        old = new.limit(0)
        if any(not n.startswith(("_", ".")) for n in _table_names(spark, path)):
            old = stored_days(spark, path, days).join(touched, ["symbol", "interval", "dt"], "left_semi").select(*new.columns)
        folder.remove(f"{name}.days")  # of a write that never became pending
        upsert_latest(old, new, KEYS, VERSION).write.parquet(folder.at(f"{name}.days").toString())
    pending = {"sequence": sequence, "writer": writer, "batch": batch if batch is not None else last, "days": len(days)}
    folder.create(f"{name}.pending.json", pending)
    _finish(spark, path, folder, state, pending)
    return sequence


def _table_names(spark: SparkSession, path: str) -> list[str]:
    if not path_exists(spark, path):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]


def stream_writer(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that a checkpoint belongs to: the id Spark keeps in it. A new checkpoint is a new writer."""
    return spark.read.text(os.path.join(checkpoint, "metadata")).select(F.get_json_object("value", "$.id")).first()[0]
