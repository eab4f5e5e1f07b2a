"""Numeric extraction and yearly rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.session import read_table
from assayer.functions import numbers as n
from assayer.functions.text import detection_text, nfkc
from assayer.plans.catalog import query
from assayer.plans.numeric_sql import ctes
from assayer.plans.oracle_parts import M
from assayer.sources import messages

_SRC = f"{M}, src AS (SELECT msg_id, 0 AS clause_no, lower(replace(replace(text, 'ओटीपी', 'OTP'), 'ওটিপি', 'OTP')) AS det FROM m), {ctes('src')}"
# Before costs are blanked, periods and percentages are read from the whole message.
_RAW = _SRC.replace("nc_text AS (SELECT msg_id, clause_no, " + n.without_costs_sql("det") + " AS t", "nc_text AS (SELECT msg_id, clause_no, det AS t")


def low_text(spark, folder):
    m = messages.templated(spark, folder)
    return m.select("msg_id", F.lower(detection_text(nfkc(F.col("text")))).alias("low"))


@query(
    "num1_periods",
    f"WITH {_RAW} SELECT msg_id, CAST(ord AS INTEGER) AS ord, CAST(pos AS INTEGER) AS pos, round(days, 6) AS days, quantified FROM nc_time",
)
def periods(spark, folder):
    """Offsets count in the matching copy; templates keep it as long as the message."""
    found = low_text(spark, folder).select("msg_id", F.explode(n.periods(F.col("low"))).alias("p"))
    return found.select("msg_id", "p.ord", "p.pos", F.round("p.days", 6).alias("days"), "p.quantified")


@query(
    "num2_amounts",
    f"WITH {_RAW} SELECT msg_id, value, coalesce(currency, '') AS currency FROM nc_money",
)
def amounts(spark, folder):
    found = low_text(spark, folder).select("msg_id", F.explode(n.amounts(F.col("low"))).alias("a"))
    return found.select("msg_id", "a.value", F.coalesce("a.currency", F.lit("")).alias("currency"))


@query("num3_percentages", f"WITH {_RAW} SELECT msg_id, CAST(pos AS INTEGER) AS pos, rate FROM nc_rate")
def percentages(spark, folder):
    found = low_text(spark, folder).select("msg_id", F.explode(n.percentages(F.col("low"))).alias("p"))
    return found.select("msg_id", "p.pos", "p.rate")


@query("num4_blank_costs", f"WITH {_SRC} SELECT msg_id, t AS shown FROM nc_text")
def blank_costs(spark, folder):
    return low_text(spark, folder).select("msg_id", n.without_costs(F.col("low")).alias("shown"))


@query(
    "num5_annualise",
    f"""SELECT event_id, round({n.annualised_sql('(1 + value / 1000)', '(event_id % 90 + 1)')}, 4) AS percent FROM events""",
)
def annualise(spark, folder):
    days = F.col("event_id") % 90 + 1
    return read_table(spark, folder, "events").select(
        "event_id", F.round(n.annualised(1 + F.col("value") / 1000, days), 4).alias("percent")
    )


@query(
    "num6_numeric_claims",
    f"WITH {_SRC} SELECT msg_id, kind, round(percent0, 4) AS percent FROM nc_claim",
)
def numeric_claims(spark, folder):
    # Exploding evaluates the claim once; a filter on it would be pushed down and repeat it.
    claim = n.numeric_claim(F.col("low"))
    claims = low_text(spark, folder).select("msg_id", F.explode(F.array(claim)).alias("c")).where("c.kind IS NOT NULL")
    return claims.select("msg_id", "c.kind", F.round(F.coalesce("c.percent", F.lit(-1.0)), 4).alias("percent"))


@query(
    "jn5_nearest_period",
    f"""WITH {_RAW} SELECT msg_id, CAST(ord AS INTEGER) AS ord, rate, round(days, 6) AS days FROM nc_rate_near WHERE rk = 1""",
)
def nearest_period(spark, folder):
    """Each percentage with the closest period; all candidates are in the message's own row."""
    low = F.col("low")
    staged = low_text(spark, folder).select("msg_id", n.percentages(low).alias("rates"), n.periods(low).alias("times"))
    each = staged.where("size(rates) > 0 AND size(times) > 0").select("msg_id", "times", F.posexplode("rates").alias("ord", "r"))
    return each.select(
        "msg_id", "ord", "r.rate", F.round(n.nearest_days(F.col("times"), F.col("r.pos")), 6).alias("days")
    )


@query(
    "jn6_multiplier_horizon",
    f"""WITH {_RAW} SELECT msg_id, CAST(ord AS INTEGER) AS ord, multiple, round(days, 6) AS days FROM nc_multiple_near WHERE rk = 1""",
)
def multiplier_horizon(spark, folder):
    low = F.col("low")
    staged = low_text(spark, folder).select("msg_id", n.multipliers(low).alias("ms"), n.periods(low).alias("times"))
    each = staged.where("size(ms) > 0 AND size(times) > 0").select("msg_id", "times", F.posexplode("ms").alias("ord", "m"))
    return each.select(
        "msg_id", "ord", "m.multiple", F.round(n.multiplier_days(F.col("times"), F.col("m.pos")), 6).alias("days")
    )
