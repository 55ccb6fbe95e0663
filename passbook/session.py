"""Session settings, the shared stage folder, and the broadcast size check."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: For local masters without that setting, in the working directory.
LOCAL_FOLDER = ".stages"
ROWS_KEY = "spark.sql.files.maxRecordsPerFile"
SPLIT_KEY = "spark.sql.files.maxPartitionBytes"
#: Rows of a file that text rules read, and the bytes a scan gives one task there: no more than
#: opening a file counts for by default, so that no task takes two files.
DENSE_ROWS = 50_000
DENSE_SPLIT = 4 << 20


def local_session(
    cpus: str = "*", shuffle_partitions: int = 8, folder: str | None = None
) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own.

    Stage tables go to ``folder``, or to ``.stages`` in the working directory.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("passbook")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CHECKPOINT_KEY, folder or os.path.abspath(LOCAL_FOLDER))
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """The shared folder for stage tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    every task sees the same disk, may fall back to a folder of its own.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    root = os.path.abspath(LOCAL_FOLDER)
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def stage(df: DataFrame, name: str, *cluster_by: str) -> DataFrame:
    """Write ``df`` as a Parquet stage table in the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of re-running the
    text cascades, and lets every later branch prune its own columns.
    """
    spark = df.sparkSession
    path = os.path.join(stage_root(spark), f"{name}-{uuid.uuid4().hex}")
    if cluster_by:
        df = df.repartition(*cluster_by)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dense(spark: SparkSession) -> Iterator[None]:
    """For stages before and after text rules: small files, read one to a task.

    A scan is split by bytes, and a few MB of rows are minutes of rules: a few long tasks
    would leave most cores waiting for the last.
    """
    wanted = {ROWS_KEY: str(DENSE_ROWS), SPLIT_KEY: str(DENSE_SPLIT)}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def small_side(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only when the optimizer's own size estimate is in bounds.

    Beyond the bound the plain DataFrame goes back, so the join shuffles.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def lookup_side(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """A stage table to look rows up in: broadcast if its rows fit ``max_bytes`` of memory.

    Rows are counted, as files of keys hold far more rows than their bytes tell. Beyond the
    bound the join is a sorted one: left to the optimizer, it might broadcast the other side,
    which it sizes too low if that comes from an explode.
    """
    # A hashed row takes some 40 bytes besides its columns.
    width = int(df._jdf.schema().defaultSize()) + 40
    return F.broadcast(df) if df.count() * width <= max_bytes else df.hint("merge")
