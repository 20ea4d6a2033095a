"""Stored ledgers of orders and scores: a log of changes and a compacted snapshot, merged on read.

A write adds one folder ``data/version=<sequence>`` of rows by id, dealt into buckets of ids; nothing stored is ever
replaced in place. What counts is listed in the commit note (``commits``): which versions are changes and which
version holds each bucket's snapshot. A note is created only after its data is complete, so a lost writer leaves a folder
that nobody reads, and a batch that comes again changes nothing. ``compact`` merges the changes of the touched
buckets into a new snapshot of those buckets only.

A field that is NULL in a change keeps its value; of several changes the later version wins field by field.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.decide import new_orders, score_rows
from tickloom.schemas import ORDERS, SCORES
from tickloom.sources.commits import Folder, latest_state

BUCKETS = 16  # of a new ledger; a ledger keeps the number it was begun with
KEY = "id"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")


def _state(folder: Folder, buckets: int) -> dict:
    state = latest_state(folder)
    return {"changes": [], "snapshot": {}, "buckets": buckets} | state


def _write(rows: DataFrame, path: str, buckets: int) -> str:
    """A folder of rows sorted by id inside each bucket, so that a reader of one id skips row groups."""
    name = f"version-{uuid.uuid4().hex}"
    laid = rows.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", KEY)
    laid.write.partitionBy("bucket").parquet(os.path.join(path, "data", name))
    return name


def append_changes(spark: SparkSession, path: str, rows: DataFrame, schema: T.StructType, writer: str, batch: int | None = None, buckets: int = BUCKETS) -> int | None:
    """Store new rows or changed fields by id; ids are distinct in ``rows``. None if this batch of this writer is stored."""
    folder = Folder(spark, path)
    state = _state(folder, buckets)
    last = state["writers"].get(writer)
    if batch is not None and last is not None and batch <= last:
        return None
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    sequence = state["sequence"] + 1
    change = [sequence, _write(full, path, state["buckets"])]
    writers = state["writers"] | {writer: batch if batch is not None else last}
    folder.create(f"{sequence:020d}.json", state | {"sequence": sequence, "writers": writers, "changes": [*state["changes"], change]})
    return sequence


def _read(spark: SparkSession, path: str, schema: T.StructType, parts: list[tuple[int, str, list[int] | None]]) -> DataFrame:
    """Rows of the listed (sequence, folder, buckets) with the sequence they were written at."""
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("sequence", T.LongType())]))
    for sequence, name, buckets in parts:
        found = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(os.path.join(path, "data", name))
        found = found if buckets is None else found.where(F.col("bucket").isin(buckets))
        out = out.union(found.withColumn("sequence", F.lit(sequence).cast("long")))
    return out


def _parts(state: dict, only: list[int] | None) -> list[tuple[int, str, list[int] | None]]:
    held: dict[tuple[int, str], list[int]] = {}
    for bucket, (sequence, name) in state["snapshot"].items():
        if only is None or int(bucket) in only:
            held.setdefault((sequence, name), []).append(int(bucket))
    return [(*k, b) for k, b in sorted(held.items())] + [(s, name, only) for s, name in state["changes"]]


def _merged(rows: DataFrame, schema: T.StructType) -> DataFrame:
    fields = [f.name for f in schema if f.name != KEY]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("sequence"))).alias(c) for c in fields]
    return rows.groupBy(KEY).agg(*newest).select(*[f.name for f in schema])


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, ids: list[int] | None = None) -> DataFrame:
    """The ledger as it stands: snapshot and changes merged. With ``ids`` only their buckets are read, and of them
    only row groups that may hold the ids."""
    state = _state(Folder(spark, path), BUCKETS)
    only = None
    if ids is not None:
        made = spark.createDataFrame([(i,) for i in ids], "id bigint").select(_bucket(state["buckets"]).alias("b"))
        only = sorted({r.b for r in made.collect()})
    rows = _read(spark, path, schema, _parts(state, only))
    return _merged(rows if ids is None else rows.where(F.col(KEY).isin(ids)), schema)


def compact(spark: SparkSession, path: str, schema: T.StructType) -> int | None:
    """Merge all changes into the snapshot of the buckets they touch. None if there are none."""
    folder = Folder(spark, path)
    state = _state(folder, BUCKETS)
    if not state["changes"]:
        return None
    touched = sorted(r.bucket for r in _read(spark, path, schema, [(s, n, None) for s, n in state["changes"]]).select("bucket").distinct().collect())
    sequence = state["sequence"] + 1
    name = _write(_merged(_read(spark, path, schema, _parts(state, touched)), schema), path, state["buckets"])
    snapshot = state["snapshot"] | {str(b): [sequence, name] for b in touched}
    folder.create(f"{sequence:020d}.json", state | {"sequence": sequence, "changes": [], "snapshot": snapshot})
    return sequence


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove folders that the newest note does not list, once no reader uses an older one; how many there were."""
    folder = Folder(spark, path)
    state = _state(folder, BUCKETS)
    held = {n for _, n in state["changes"]} | {n for _, n in state["snapshot"].values()}
    data = Folder(spark, path, "data")
    gone = [n for n in data.names() if n not in held]
    for n in gone:
        data.remove(n)
    for note in folder.names():
        if note.endswith(".json") and int(note.split(".")[0]) < state["sequence"]:
            folder.remove(note)
    return len(gone)


def write_orders(spark: SparkSession, path: str, decided: DataFrame, writer: str, batch: int | None = None, buckets: int = BUCKETS) -> int | None:
    """The valid decisions as NEW orders."""
    return append_changes(spark, path, new_orders(decided).withColumn("retry_count", F.lit(0)), ORDERS, writer, batch, buckets)


def write_scores(spark: SparkSession, path: str, decided: DataFrame, writer: str, batch: int | None = None, buckets: int = BUCKETS) -> int | None:
    """Every decision as a score row."""
    return append_changes(spark, path, score_rows(decided), SCORES, writer, batch, buckets)
