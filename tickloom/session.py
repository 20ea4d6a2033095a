"""Session defaults and the shared folder used for checkpoints and written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tickloom", cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and benches; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """All date arithmetic here is in UTC; pin the session so that results do not follow the host zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. The cluster names it in ``spark.checkpoint.dir``; only a local
    session without that setting falls back to a temporary folder of its own."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tickloom-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``clean_up`` removes what was written there."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete the intermediates this driver has written, once no frame that reads them is needed any more.
    Returns how many there were."""
    count = 0
    while _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        count += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return count


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back; survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
