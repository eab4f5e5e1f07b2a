"""Structured Streaming jobs over message and event tables.

Late data: each job's watermark is its own horizon; later rows are dropped.
Results are written per micro-batch under its id, so a replayed batch replaces
its own output, and read back as one table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.core.session import named_dir, shared_dir, table_path
from assayer.operators import streaks
from assayer.plans.screening import lexicon_findings
from assayer.sources import messages

HOLD_MINUTES = 15
DUPLICATE_SECONDS = 6 * 3600
#: How far rows of the failure streaks may be out of order.
LATE_SECONDS = 24 * 3600


def read_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream; local timestamps become instants, as watermarks require."""
    path = table_path(folder, table)
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A stream reads folders; a table that is a single file is picked out of its folder by name.
    files = batch.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{table}.parquet"):
        reader, path = reader.option("pathGlobFilter", f"{table}.parquet"), folder
    stream = reader.parquet(path)
    if "ts" in stream.columns:
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream


def run(stream: DataFrame, mode: str, purpose: str, transform=None, name: str | None = None, watch=None) -> DataFrame:
    """Run a stream over all available input; returns its output with a ``batch`` column.

    A job with a ``name`` keeps its checkpoint and output under it: started again,
    after a failure or when input has come, it goes on where it stopped and returns
    the whole output. Without a name every run starts anew. ``watch`` is handed the
    progress of every batch.
    """
    spark = stream.sparkSession
    out = named_dir(spark, f"{purpose}/{name}") if name else shared_dir(spark, purpose)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    shape = transform(stream.sparkSession.createDataFrame([], stream.schema)) if transform else stream
    # An empty first part gives the output its schema even if no batch has rows.
    spark.createDataFrame([], shape.schema).write.mode("overwrite").parquet(f"{out}/rows/batch=-1")
    running = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    if watch:
        watch(running.recentProgress)
    return spark.read.parquet(f"{out}/rows")


def latest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last update per key of an update-mode output."""
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def intake(spark: SparkSession, folder: str, name: str | None = None, **options) -> DataFrame:
    """Message intake: trimmed, masked and bounded text with its status, by the batch's own function."""
    stream = read_stream(spark, folder, "documents", **options).select(F.col("doc_id").alias("msg_id"), "lang", "text")
    return run(stream, "append", "intake", messages.prepared, name).drop("batch")


def client_rate(events: DataFrame, width: str) -> DataFrame:
    """Requests per client and tumbling window; batch and streaming alike."""
    return events.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n")).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n"
    )


def client_rate_stream(spark: SparkSession, folder: str, width: str, limit: int, **options) -> DataFrame:
    events = read_stream(spark, folder, "events", **options).withWatermark("ts", width)
    counted = latest(run(client_rate(events, width), "update", "client-rate"), ["start", "user_id"], "n")
    return counted.where(F.col("n") > limit)


def outcome_rate_stream(spark: SparkSession, folder: str, project, **options) -> DataFrame:
    """Running outcome counters per hour."""
    events = read_stream(spark, folder, "events", **options).withWatermark("ts", "1 hour")
    hourly = project(events).groupBy(F.window("ts", "1 hour"), "event").agg(F.count("*").alias("n")).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event", "n"
    )
    return latest(run(hourly, "update", "outcomes"), ["start", "event"], "n")


def held_until_sign_in(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Pending items met by a sign-in of the same user within 15 minutes.

    Both sides also meet on a 15-minute slot, the later side being offered to its
    own slot and the one before, so a busy user spreads over many partitions.
    """
    slot = F.floor(F.unix_seconds("ts") / (HOLD_MINUTES * 60))
    held = (
        read_stream(spark, folder, "events", **options).where("event_type = 'view'")
        .select(F.col("ts").alias("held_ts"), F.col("user_id").alias("held_user"), F.col("event_id").alias("held_id"))
        .withWatermark("held_ts", "15 minutes")
    )
    held = held.withColumn("held_slot", F.floor(F.unix_seconds("held_ts") / (HOLD_MINUTES * 60)))
    used = (
        read_stream(spark, folder, "events", **options).where("event_type = 'purchase'")
        .select("ts", "user_id", F.col("event_id").alias("used_id"), F.explode(F.array(slot, slot - 1)).alias("slot"))
        .withWatermark("ts", "15 minutes")
    )
    within = F.expr(
        f"held_user = user_id AND held_slot = slot AND ts >= held_ts AND ts <= held_ts + INTERVAL {HOLD_MINUTES} MINUTES"
    )
    return run(held.join(used, within), "append", "held").select("user_id", "held_id", "used_id")


def _first_per_second(batches):
    # Stateless: of many copies within one second only the earliest can be kept,
    # so a hot key sends at most one row per second and Arrow batch to its state.
    for rows in batches:
        rows = rows.sort_values(["at", "event_id"])
        yield rows.drop_duplicates(["content", "second"])


def _first_sight(key, chunks, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    rows = pd.concat(
        [c.sort_values(["at", "event_id"]).drop_duplicates(["second"]) for c in chunks], ignore_index=True
    ).sort_values(["at", "event_id"]).drop_duplicates(["second"])
    kept = []
    for at, second, event_id in zip(rows["at"], rows["second"], rows["event_id"]):
        if last is None or second >= last + DUPLICATE_SECONDS:
            kept.append((key[0], event_id, second))
            last = second
    if last is not None:
        state.update((int(last),))
        # On time rows are not older than the watermark, so the end of the horizon lies ahead of it.
        state.setTimeoutTimestamp((int(last) + DUPLICATE_SECONDS) * 1000)
    yield pd.DataFrame(kept, columns=["content", "event_id", "second"])


def first_sight(
    spark: SparkSession, folder: str, version: str = "1", name: str | None = None, watch=None, **options
) -> DataFrame:
    """Suppress identical content for six hours from the row last let through.

    Expiry is compared on whole seconds. State is one number per content and
    ``version`` (of the rules that would answer it: another version sees content
    anew); an event-time timer removes it when its six hours are over. Rows may be
    six hours late; later ones are dropped.
    """
    keyed = read_stream(spark, folder, "events", **options).select(
        F.concat_ws(":", "user_id", "event_type").alias("content"), F.lit(version).alias("version"),
        F.unix_micros("ts").alias("at"), F.unix_seconds("ts").alias("second"), "event_id", "ts",
    )
    thinned = keyed.mapInPandas(_first_per_second, keyed.schema).withWatermark("ts", f"{DUPLICATE_SECONDS} seconds")
    kept = thinned.groupBy("content", "version").applyInPandasWithState(
        _first_sight, "content STRING, event_id BIGINT, second BIGINT", "last BIGINT", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return run(kept, "append", "first-sight", name=name, watch=watch).select("content", "event_id")


def failure_streaks_stream(
    spark: SparkSession, folder: str, late_seconds: int = LATE_SECONDS, name: str | None = None, **options
) -> DataFrame:
    """Consecutive failures per user with the capped doubling penalty, in event time.

    Rows may come out of order by up to ``late_seconds``: a row waits until the
    clock (newest time seen, less that) has passed it, so streaks are counted in the
    order of events and not of files. Rows older than the clock are dropped. Each
    batch is one job of the batch operator: a hot user is divided into time slices
    and only streaks that are not over go on to the next batch. Rows that still wait
    at the end are counted as they stand.
    """
    events = read_stream(spark, folder, "events", **options).select(
        "user_id", "event_id", F.unix_micros("ts").alias("at"), (F.col("event_type") == "error").alias("failed")
    )
    out = named_dir(spark, f"streaks/{name}") if name else shared_dir(spark, "streaks")

    def table(kind: str, batch_id: int) -> str:
        return f"{out}/{kind}/batch={batch_id}"

    def settled(rows: DataFrame, kind: str, batch_id: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(table(kind, batch_id))
        return spark.read.schema(rows.schema).parquet(table(kind, batch_id))

    def left_by(batch_id: int) -> tuple[DataFrame, DataFrame, int | None]:
        """Rows that wait, streaks that are not over and the clock after a batch."""
        clock = spark.read.parquet(table("clock", batch_id)).first().clock
        seen, carried = (spark.read.parquet(table(kind, batch_id)) for kind in ("seen", "carried"))
        return (seen if clock is None else seen.where(F.col("at") > clock)), carried, clock

    def step(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch reads what its predecessor left and replaces its own tables.
        waiting, carried, clock = left_by(batch_id - 1)
        fresh = batch if clock is None else batch.where(F.col("at") > clock)
        seen = settled(waiting.unionByName(fresh), "seen", batch_id)
        newest = seen.agg(F.max("at")).first()[0]
        if newest is not None:
            due = newest - late_seconds * 1_000_000
            clock = due if clock is None else max(clock, due)
        ripe = seen.where(F.lit(False) if clock is None else F.col("at") <= clock)
        settled(streaks.failure_streaks(ripe, carried=carried), "rows", batch_id)
        settled(streaks.standing(ripe, carried=carried), "carried", batch_id)
        settled(spark.createDataFrame([(clock,)], "clock BIGINT"), "clock", batch_id)

    nothing = spark.createDataFrame([], events.schema)
    settled(nothing, "seen", -1)
    settled(streaks.standing(nothing), "carried", -1)
    settled(streaks.failure_streaks(nothing), "rows", -1)
    settled(spark.createDataFrame([(None,)], "clock BIGINT"), "clock", -1)
    events.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    waiting, carried, _ = left_by(spark.read.parquet(f"{out}/clock").agg(F.max("batch")).first()[0])
    done = spark.read.parquet(f"{out}/rows").drop("batch")
    return done.unionByName(streaks.failure_streaks(waiting, carried=carried))


def continuous_screening(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Screen a document stream; a message is whole within its batch, so each batch stands alone."""
    stream = read_stream(spark, folder, "documents", **options).select(F.col("doc_id").alias("msg_id"), "text")
    return run(stream, "append", "screening", lexicon_findings).drop("batch")
