"""Saved checks: upsert, newest-per-user, size guard, partitioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.core.session import settle

ROW_BYTES = 65536


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of both sides; incoming wins, then the newest, then the highest id.

    The winner is a maximum, so every task reduces its versions first and a hot
    user never sends more than one row per check and task.
    """
    both = stored.withColumn("priority", F.lit(0)).unionByName(incoming.withColumn("priority", F.lit(1)))
    rest = [c for c in both.columns if c not in ("user_id", "check_id", "priority", "saved_at", "event_id")]
    best = F.max(F.struct("priority", "saved_at", "event_id", *rest)).alias("best")
    return both.groupBy("user_id", "check_id").agg(best).select("user_id", "check_id", "best.*")


def newest(checks: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` checks per user; the rank limit is applied before the shuffle too."""
    order = Window.partitionBy("user_id").orderBy(F.desc("saved_at"), "event_id")
    return checks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def judged(rows: DataFrame, required: list[str]) -> DataFrame:
    """Flag rows that fit the stored size and carry every required field."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    return rows.withColumn("n_bytes", size).withColumn("accepted", (F.col("n_bytes") <= ROW_BYTES) & complete)


def write_split(rows: DataFrame, required: list[str], path: str) -> None:
    """Write accepted and quarantined rows side by side in one pass."""
    judged(rows, required).write.mode("overwrite").partitionBy("accepted").parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("user_id"), F.lit(buckets))


def create(checks: DataFrame, path: str, buckets: int = 16) -> None:
    """Write a store of the best version per check, partitioned by a user bucket.

    A bucket's rows come from all tasks of the reduction, so no single task writes a hot user.
    """
    best = upsert(checks, checks.limit(0))
    best.withColumn("bucket", _bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge(path: str, incoming: DataFrame, buckets: int = 16) -> DataFrame:
    """Merge checks into a store and return it; only buckets that receive rows are read and rewritten.

    ``buckets`` is the number the store was created with. The new state is settled in
    the shared folder before the touched partitions are replaced, so a lost executor
    never leaves the job to reread files that are being replaced.
    """
    spark = incoming.sparkSession
    fresh = settle(incoming.withColumn("bucket", _bucket(buckets)), "incoming-checks")
    touched = [row.bucket for row in fresh.select("bucket").distinct().collect()]
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    if stored.where(F.col("bucket") != _bucket(buckets)).limit(1).count():
        raise ValueError(f"the store was not made with {buckets} buckets")
    if touched:
        merged = settle(upsert(stored.drop("priority"), fresh), "merged-checks")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path)
