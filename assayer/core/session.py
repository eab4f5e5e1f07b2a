"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(cores: int | str = 8, app: str = "assayer", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("assayer.local.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="assayer-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the checkpoint root the cluster names.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, because a machine-local path would
    not survive the loss of that machine.
    """
    return f"{_shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def named_dir(spark: SparkSession, name: str) -> str:
    """A folder below the same root that keeps its name, for work that is resumed."""
    return f"{_shared_root(spark)}/named/{name}"


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/assayer"


def settle(df: DataFrame, purpose: str, schema: T.StructType | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write a reused intermediate once to shared storage and read it back.

    The written table has no lineage to replay when executors are lost. ``schema``
    names types to read that are stored like the written ones, such as vectors.
    ``group_bytes`` is for wide rows: it bounds a row group, and with it what a batch takes
    when it is read, as a batch is thousands of rows, but of one row group.
    """
    path = shared_dir(df.sparkSession, purpose)
    writer = df.write.mode("overwrite")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes).option("compression", "zstd")
    writer.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def table_path(folder: str, name: str) -> str:
    return os.path.join(folder, f"{name}.parquet")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(folder, name))


#: Tasks for each core that narrow rows are dealt over.
DEALT = 4


def spread(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Deal out a scan over ``assayer.local.partitions`` tasks, where a session sets that.

    A local session does, for tables that are one small file and would else be
    read by one core. A cluster leaves it unset: its tables arrive in many splits
    (``spark.sql.files.maxPartitionBytes``) and texts are not shuffled to balance
    them. ``narrow`` rows are a few numbers that each become a text to work on: a
    split of them is hours of work for one core, so they are dealt over the
    cluster's cores, unless the scan has as many splits.
    """
    tasks = df.sparkSession.conf.get("assayer.local.partitions", None)
    if tasks:
        return df.repartition(int(tasks))
    wanted = DEALT * df.sparkSession.sparkContext.defaultParallelism if narrow else 0
    return df.repartition(wanted) if wanted > 1 and df.rdd.getNumPartitions() < wanted else df
