"""Consecutive-failure streaks as a batch job that splits hot keys by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Penalty base and cap in seconds while a service is busy.
BASE_SECONDS, CAP_SECONDS = 60, 15 * 60
#: The slice of what is carried in.
BEFORE_ALL = -(1 << 62)


def penalty(streak: Column, base: int = BASE_SECONDS, cap: int = CAP_SECONDS) -> Column:
    """Doubling penalty with a cap; the exponent is bounded so it cannot overflow."""
    return F.least(F.lit(base) * F.pow(F.lit(2), F.least(streak, F.lit(40)) - 1), F.lit(cap)).cast("bigint")


def _sliced(events: DataFrame, slice_seconds: int) -> DataFrame:
    return events.withColumn("slice", F.floor(F.col("at") / (slice_seconds * 1_000_000)))


def _reach(sliced: DataFrame, carried: DataFrame | None) -> DataFrame:
    """(user_id, slice, reach): the streak a user stands at when a slice ends, from one row per slice.

    ``carried`` (user_id, streak) is a slice before all others.
    """
    reset_at = F.max(F.when(~F.col("failed"), F.struct("at", "event_id")))
    last = sliced.groupBy("user_id", "slice").agg(reset_at.alias("reset"))
    tail = (
        sliced.join(last, ["user_id", "slice"])
        .where(F.col("failed") & (F.col("reset").isNull() | (F.struct("at", "event_id") > F.col("reset"))))
        .groupBy("user_id", "slice").agg(F.count("*").alias("tail"))
    )
    ends = last.join(tail, ["user_id", "slice"], "left").select(
        "user_id", "slice", F.coalesce("tail", F.lit(0)).alias("tail"), F.col("reset").isNotNull().cast("int").alias("cut")
    )
    if carried is not None:
        ends = ends.unionByName(carried.select(
            "user_id", F.lit(BEFORE_ALL).alias("slice"), F.col("streak").alias("tail"), F.lit(0).alias("cut")
        ))
    order = Window.partitionBy("user_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("user_id", "island").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumn("island", F.sum("cut").over(order)).select(
        "user_id", "slice", F.sum("tail").over(along).alias("reach")
    )


def failure_streaks(events: DataFrame, slice_seconds: int = 3600, carried: DataFrame | None = None) -> DataFrame:
    """Streak of every failure per user, reset by any success.

    ``events`` has (user_id, event_id, at in microseconds, failed); ``carried`` the
    streaks (user_id, streak) users come with. Streaks are counted inside (user,
    time slice) first; a slice then only hands on how many failures it ends with.
    The carry runs over one row per slice, so even a user with a third of all events
    is spread over all slices.
    """
    sliced = _sliced(events, slice_seconds)
    inside = Window.partitionBy("user_id", "slice").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = sliced.withColumn("run", F.count_if(~F.col("failed")).over(inside))
    in_run = Window.partitionBy("user_id", "slice", "run").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("local", F.count_if("failed").over(in_run))
    before = F.lag("reach").over(Window.partitionBy("user_id").orderBy("slice"))
    carry = _reach(sliced, carried).select("user_id", "slice", F.coalesce(before, F.lit(0)).alias("carry"))
    joined = local.where("failed").join(carry, ["user_id", "slice"])
    streak = F.col("local") + F.when(F.col("run") == 0, F.col("carry")).otherwise(0)
    return joined.select("user_id", "event_id", streak.alias("streak"), penalty(streak).alias("penalty"))


def standing(events: DataFrame, slice_seconds: int = 3600, carried: DataFrame | None = None) -> DataFrame:
    """(user_id, streak) of users that end in failures; what a later part of the events is ``carried``."""
    ends = _reach(_sliced(events, slice_seconds), carried)
    return ends.groupBy("user_id").agg(F.max_by("reach", "slice").alias("streak")).where("streak > 0")
