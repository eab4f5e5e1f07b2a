"""Streaming jobs; oracles state the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.session import read_table
from assayer.operators import streaks
from assayer.plans.catalog import query
from assayer.plans.queries_aggregates import OUTCOMES_SQL, outcome_events
from assayer.plans.queries_rules import _LEX_HITS
from assayer.streaming import jobs

_RATE = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1"""


@query("str1_client_rate", _RATE)
def client_rate(spark, folder):
    return jobs.client_rate_stream(spark, folder, "1 hour", 1)


@query("str1_client_rate_batch", _RATE)
def client_rate_batch(spark, folder):
    events = read_table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return jobs.client_rate(events, "1 hour").where("n > 1")


@query(
    "str2_duplicate_suppression",
    """WITH RECURSIVE c AS (SELECT concat_ws(':', user_id, event_type) AS content, epoch_us(ts) // 1000000 AS sec, arg_min(event_id, {'a': ts, 'b': event_id}) AS event_id
                            FROM events GROUP BY ALL),
       k AS (SELECT content, min(sec) AS sec FROM c GROUP BY content
             UNION ALL SELECT k.content, min(c.sec) FROM k JOIN c ON c.content = k.content AND c.sec >= k.sec + 21600 GROUP BY k.content)
       SELECT content, event_id FROM k JOIN c USING (content, sec)""",
)
def duplicate_suppression(spark, folder):
    return jobs.first_sight(spark, folder)


@query(
    "str3_hold_until_sign_in",
    """SELECT a.user_id, a.event_id AS held_id, b.event_id AS used_id FROM events a JOIN events b ON a.user_id = b.user_id
       AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 15 MINUTE WHERE a.event_type = 'view' AND b.event_type = 'purchase'""",
)
def hold_until_sign_in(spark, folder):
    return jobs.held_until_sign_in(spark, folder)


_STREAKS = f"""SELECT user_id, event_id, streak, CAST(least({streaks.BASE_SECONDS} * pow(2, least(streak, 40) - 1), {streaks.CAP_SECONDS}) AS BIGINT) AS penalty FROM (
  SELECT user_id, event_id, failed, row_number() OVER (PARTITION BY user_id, run, failed ORDER BY ts, event_id) AS streak FROM (
    SELECT *, event_type = 'error' AS failed, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events))
  WHERE failed"""


@query("str4_failure_streaks", _STREAKS)
def failure_streaks(spark, folder):
    return jobs.failure_streaks_stream(spark, folder)


@query("str4_failure_streaks_batch", _STREAKS)
def failure_streaks_batch(spark, folder):
    events = read_table(spark, folder, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("event_type") == "error").alias("failed"),
    )
    return streaks.failure_streaks(events)


@query("str5_continuous_screening", f"WITH {_LEX_HITS} SELECT msg_id, rule_id, min(clause_no) AS clause_no FROM lh GROUP BY ALL")
def continuous_screening(spark, folder):
    return jobs.continuous_screening(spark, folder).select("msg_id", "rule_id", "clause_no")


@query(
    "str6_outcome_counters",
    f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event, count(*) AS n FROM ({OUTCOMES_SQL}) GROUP BY ALL",
)
def outcome_counters(spark, folder):
    return jobs.outcome_rate_stream(spark, folder, outcome_events)
