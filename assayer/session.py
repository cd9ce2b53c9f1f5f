"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Working folders chosen for local sessions that configure none, by application id.
_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and for ``bench.py``; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("assayer")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(
            "Set spark.checkpoint.dir to a folder that all executors share."
        )
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="assayer-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, purpose: str) -> str:
    """A path that nothing has written to yet, in the application's part of the shared folder.

    Working tables stay until that part is deleted, once the application has ended.
    """
    folder = f"{shared_dir(spark)}/assayer-{spark.sparkContext.applicationId}"
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage without depending on the executors that computed the rows, and
    pins values (row numbers, partition ids) that a recomputation could change.
    """
    path = new_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint ``df`` for broadcast when it is shown to hold at most ``max_rows`` rows.

    Otherwise the frame is returned without a hint, and the join shuffles both sides
    (adaptive execution splits a skewed partition).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
