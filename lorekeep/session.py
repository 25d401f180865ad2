"""Session helpers: sane local defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local benches. On a cluster, pass in the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lorekeep")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config(SCAN_PARTITIONS, str(os.cpu_count() if cpus == "*" else cpus))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; every executor must be able to reach it.

    Only a local-mode session may fall back to a fresh temporary folder, since there driver and
    executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lorekeep-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def place(folder: str):
    """File system and path of a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that lost executors never replay its
    history. Parquet rather than a row checkpoint: later readers take only the columns they need."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions of some ``rows`` each, at least the session's shuffle partitions, so that what a task does and holds does
    not grow with the input. ``df`` is counted, so pass a table or a cheap projection of one."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // rows))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deals rows out by ``keys`` to ``tasks_for`` so many."""
    return df.repartition(tasks_for(df, rows), *keys)


# How many partitions scans of pages and texts are dealt out to; unset, they stay as they are split.
SCAN_PARTITIONS = "lorekeep.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out before work that costs more than moving them, if the session asks for it.

    For local runs over files of one row group, each of which is one task however many cores wait. It
    depends on the setting alone, never on the size of the input; a cluster leaves it unset.
    """
    wanted = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df
