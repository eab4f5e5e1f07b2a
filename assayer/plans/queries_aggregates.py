"""Evaluation tallies, counters and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.dims import dim_sql
from assayer.core.session import read_table
from assayer.functions import stats
from assayer.operators import rules
from assayer.operators.quality import match_summary as summarise
from assayer.packs import library, templates
from assayer.plans.catalog import query
from assayer.plans.oracle_parts import FINDINGS, RISK
from assayer.sources import messages


def _tiers(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text", "lang", "expected", "theme")
    return rules.tiers(m)


def _flagged():
    return F.size("reason_ids") > 0


@query(
    "agg3_confusion_by_language",
    f"""WITH {RISK} SELECT *, round((risky_flagged + harmless - harmless_flagged) * 1.0 / total, 4) AS accuracy,
               round(harmless_flagged * 1.0 / greatest(1, harmless), 4) AS false_alarms
        FROM (SELECT coalesce(lang, 'ALL') AS lang, count(*) AS total, count(*) FILTER (expected) AS risky,
                     count(*) FILTER (expected AND n_reasons > 0) AS risky_flagged, count(*) FILTER (NOT expected) AS harmless,
                     count(*) FILTER (NOT expected AND n_reasons > 0) AS harmless_flagged,
                     count(*) FILTER (NOT expected AND level = 'strong') AS harmless_strong
              FROM mr GROUP BY ROLLUP (lang))""",
)
def confusion(spark, folder):
    risky, harmless = F.col("expected"), ~F.col("expected")
    tally = _tiers(spark, folder).withColumn("flagged", _flagged()).rollup("lang").agg(
        F.count("*").alias("total"),
        F.count_if(risky).alias("risky"),
        F.count_if(risky & F.col("flagged")).alias("risky_flagged"),
        F.count_if(harmless).alias("harmless"),
        F.count_if(harmless & F.col("flagged")).alias("harmless_flagged"),
        F.count_if(harmless & (F.col("level") == "strong")).alias("harmless_strong"),
    )
    right = F.col("risky_flagged") + F.col("harmless") - F.col("harmless_flagged")
    return tally.withColumns({
        "lang": F.coalesce("lang", F.lit("ALL")),
        "accuracy": F.round(right / F.col("total"), 4),
        "false_alarms": F.round(F.col("harmless_flagged") / F.greatest(F.lit(1), F.col("harmless")), 4),
    })


def _quality_sql(metric: str, num: str, den: str) -> str:
    return (
        f"SELECT '{metric}' AS metric, {num} AS numerator, {den} AS denominator, {stats.ratio_sql(num, den)} AS fraction, "
        f"{stats.wilson_sql(num, den, False)} AS low, {stats.wilson_sql(num, den, True)} AS high FROM t"
    )


_METRICS = [
    ("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("false-positive rate", "fp", "fp + tn"),
    ("agreement", "tp + tn", "tp + fp + tn + fn"),
]


def quality(counts):
    """Precision, recall, false-positive rate and agreement with their intervals, one row each."""
    def metric(name, num, den):
        n, d = F.expr(num), F.expr(den)
        return F.struct(
            F.lit(name).alias("metric"), n.alias("numerator"), d.alias("denominator"), stats.ratio(n, d).alias("fraction"),
            stats.wilson(n, d, False).alias("low"), stats.wilson(n, d, True).alias("high"),
        )

    return counts.select(F.explode(F.array(*[metric(*m) for m in _METRICS])).alias("m")).select("m.*")


_COUNTS = """SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp,
                    count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn"""


def _counts(df):
    y, p = F.col("y"), F.col("p")
    return df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")
    )


@query(
    "agg4_quality_with_intervals",
    f"WITH {RISK}, t AS ({_COUNTS} FROM (SELECT expected AS y, n_reasons > 0 AS p FROM mr)) "
    + " UNION ALL ".join(_quality_sql(m, f"({n})", f"({d})") for m, n, d in _METRICS),
)
def quality_with_intervals(spark, folder):
    return quality(_counts(_tiers(spark, folder).select(F.col("expected").alias("y"), _flagged().alias("p"))))


@query(
    "agg4_quality_of_labels",
    f"WITH t AS ({_COUNTS} FROM (SELECT quality = 0 AS y, toxic = 1 AS p FROM labels)) "
    + " UNION ALL ".join(_quality_sql(m, f"({n})", f"({d})") for m, n, d in _METRICS),
)
def quality_of_labels(spark, folder):
    labels = read_table(spark, folder, "labels")
    return quality(_counts(labels.select((F.col("quality") == 0).alias("y"), (F.col("toxic") == 1).alias("p"))))


@query(
    "agg5_tier_by_expectation",
    f"""WITH {RISK} SELECT expected, count(*) FILTER (level = 'strong') AS strong, count(*) FILTER (level = 'potential') AS potential,
               count(*) FILTER (level = 'insufficient') AS insufficient FROM mr GROUP BY expected""",
)
def tier_by_expectation(spark, folder):
    tiers = _tiers(spark, folder)
    return tiers.groupBy("expected").pivot("level", ["strong", "potential", "insufficient"]).count().na.fill(0)


@query(
    "agg6_category_matches",
    f"""WITH {FINDINGS} SELECT theme, count(*) AS n_expected, count(*) FILTER (hit) AS n_matched FROM (
        SELECT m.theme, EXISTS (SELECT 1 FROM f WHERE f.msg_id = m.msg_id AND f.rule_id = m.theme AND f.severity = 'attention') AS hit
        FROM m WHERE expected) GROUP BY theme""",
)
def category_matches(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text", "theme", "expected")
    found = rules.findings(m.select("msg_id", "text"), with_mask=False).where("severity = 'attention'").select(
        "msg_id", F.col("rule_id").alias("theme"), F.lit(True).alias("hit")
    )
    expected = m.where("expected").select("msg_id", "theme").join(found, ["msg_id", "theme"], "left")
    return expected.groupBy("theme").agg(F.count("*").alias("n_expected"), F.count_if("hit").alias("n_matched"))


# News and service notices state what others did or what is due: no scored wording to expect.
_UNSCORED = ", ".join(str(t) for t, purpose, _ in templates.REVIEWED_PURPOSE if purpose in ("news", "service"))


@query(
    "agg6_match_summary",
    f"""WITH {RISK}, s AS (SELECT *, template_id NOT IN ({_UNSCORED}) AS scored, n_reasons > 0 AS warned,
                                 list_contains(string_split(reasons, ','), theme) AS matched FROM mr)
        SELECT *, round(risky_warned / nullif(risky_warned + controls_warned, 0), 6) AS precision, round(risky_warned / nullif(n_risky, 0), 6) AS recall,
               round(controls_warned / nullif(n_controls, 0), 6) AS false_alarms FROM (
          SELECT lang, count(*) AS n, count(*) FILTER (scored AND expected) AS n_risky, count(*) FILTER (scored AND expected AND warned) AS risky_warned,
                 count(*) FILTER (scored AND expected AND matched) AS risky_matched, count(*) FILTER (scored AND NOT expected) AS n_controls,
                 count(*) FILTER (scored AND NOT expected AND warned) AS controls_warned,
                 count(*) FILTER (scored AND NOT expected AND n_findings > 0) AS controls_found,
                 count(*) FILTER (NOT scored) AS n_not_assessable, count(*) FILTER (NOT scored AND n_findings > 0) AS not_assessable_found
          FROM s GROUP BY lang)""",
)
def match_summary(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text", "lang", "expected", "theme", "template_id")
    rows = rules.tiers(m).withColumn("assessable", F.expr(f"template_id NOT IN ({_UNSCORED})"))
    return summarise(rows.withColumnRenamed("theme", "category"), "lang")


@query(
    "agg7_held_out_summary",
    """SELECT source, count(*) AS total, count(*) FILTER (risky) AS risky, count(*) FILTER (risky AND flagged) AS risky_flagged,
              count(*) FILTER (NOT risky) AS harmless, count(*) FILTER (NOT risky AND flagged) AS harmless_flagged
       FROM (SELECT source, quality = 0 AS risky, (doc_id * 37 % 101) / 100.0 >= 0.7 AS flagged FROM documents JOIN labels USING (doc_id)) GROUP BY source""",
)
def held_out_summary(spark, folder):
    """Summary per held-out source over recorded scores (training itself is ``mdl4``)."""
    labels = read_table(spark, folder, "labels").select("doc_id", (F.col("quality") == 0).alias("risky"))
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    scored = docs.join(labels, "doc_id").withColumn("score", (F.col("doc_id") * 37 % 101) / 100)
    return summarise_held_out(scored)


def summarise_held_out(scored, threshold: float = 0.7):
    flagged, risky = F.col("score") >= threshold, F.col("risky")
    return scored.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(risky).alias("risky"), F.count_if(risky & flagged).alias("risky_flagged"),
        F.count_if(~risky).alias("harmless"), F.count_if(~risky & flagged).alias("harmless_flagged"),
    )


# --- outcome counters ---------------------------------------------------------------

# Status codes kept apart; others fall into their hundred.
STATUSES = ("200", "400", "401", "403", "404", "429", "500", "502", "503", "504")


def outcome_events(events):
    """Diagnostic events projected from ``events``: no identity or payload is kept."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    name = F.when(kind.isin("click", "view", "purchase"), "physical-finish").when(kind == "error", "validation").otherwise("cooldown")
    status = F.when(k % 10 == 0, F.lit(None).cast("int")).otherwise(F.element_at(F.array(*[F.lit(c) for c in (200, 200, 429, 503, 418, 302)]), k % 6 + 1))
    return events.select(
        "event_id", "ts", name.alias("event"),
        F.when(k % 2 == 0, "proposal").otherwise("confirmation").alias("pass"),
        status.alias("status"),
        F.when(k % 3 == 0, "rate-limit").when(k % 3 == 1, "busy").otherwise("none").alias("failure"),
        F.when(k % 4 == 0, "per-day").when(k % 4 == 1, "per-minute").otherwise("unknown").alias("quota_scope"),
        F.when(k % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("value") * 10000).alias("retry_delay_ms"),
    )


OUTCOMES_SQL = """SELECT event_id, ts, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'physical-finish' WHEN event_type = 'error' THEN 'validation' ELSE 'cooldown' END AS event,
  CASE WHEN k % 2 = 0 THEN 'proposal' ELSE 'confirmation' END AS pass,
  CASE WHEN k % 10 = 0 THEN NULL ELSE [200, 200, 429, 503, 418, 302][k % 6 + 1] END AS status,
  CASE WHEN k % 3 = 0 THEN 'rate-limit' WHEN k % 3 = 1 THEN 'busy' ELSE 'none' END AS failure,
  CASE WHEN k % 4 = 0 THEN 'per-day' WHEN k % 4 = 1 THEN 'per-minute' ELSE 'unknown' END AS quota_scope,
  CASE WHEN k % 5 = 0 THEN NULL ELSE value * 10000 END AS retry_delay_ms
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def status_bucket(status):
    exact = status.cast("string")
    return F.when(status.isNull(), "no-response").when(exact.isin(*STATUSES), exact).otherwise(
        F.concat(F.floor(status / 100).cast("string"), F.lit("xx-other"))
    )


def retry_bucket(delay):
    return (
        F.when(delay.isNull(), "none").when(delay <= 1000, "up-to-1s").when(delay <= 60000, "up-to-1m")
        .when(delay <= 3600000, "up-to-1h").otherwise("over-1h")
    )


BUCKETS_SQL = f"""SELECT *, CASE WHEN status IS NULL THEN 'no-response' WHEN CAST(status AS VARCHAR) IN {STATUSES} THEN CAST(status AS VARCHAR)
    ELSE CAST(status // 100 AS VARCHAR) || 'xx-other' END AS status_bucket,
  CASE WHEN retry_delay_ms IS NULL THEN 'none' WHEN retry_delay_ms <= 1000 THEN 'up-to-1s' WHEN retry_delay_ms <= 60000 THEN 'up-to-1m'
       WHEN retry_delay_ms <= 3600000 THEN 'up-to-1h' ELSE 'over-1h' END AS retry_bucket FROM ({OUTCOMES_SQL})"""

_DIMENSIONS = ("pass", "status_bucket", "quota_scope", "failure", "retry_bucket")
# Fixed value: the largest whole number that a double holds exactly.
COUNTER_LIMIT = 2**53 - 1


def counters(events, limit: int = COUNTER_LIMIT):
    """Saturating counters per event name, and per dimension of finished calls only.

    One aggregation over grouping sets; each counter is a single row.
    """
    rows = outcome_events(events).withColumns(
        {"status_bucket": status_bucket(F.col("status")), "retry_bucket": retry_bucket(F.col("retry_delay_ms"))}
    )
    done = F.col("event") == "physical-finish"
    # A null outside the finished calls keeps other events out of the attempt counters.
    marked = rows.select("event", *[F.when(done, F.col(d)).alias(d) for d in _DIMENSIONS])
    sets = [[F.col(c)] for c in ("event", *_DIMENSIONS)]
    grouped = marked.groupingSets(sets, "event", *_DIMENSIONS).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    names = ("event", *_DIMENSIONS)
    pairs = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("dimension"), F.col(c).alias("bucket"))) for c in names])
    return grouped.select(pairs.alias("p"), F.least(F.col("n"), F.lit(limit)).alias("n")).where("p IS NOT NULL").select("p.*", "n")


@query(
    "agg8_outcome_counters",
    f"WITH b AS ({BUCKETS_SQL}) SELECT 'event' AS dimension, event AS bucket, least(count(*), {COUNTER_LIMIT}) AS n FROM b GROUP BY event UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{d}', {d}, least(count(*), {COUNTER_LIMIT}) FROM b WHERE event = 'physical-finish' GROUP BY {d}" for d in _DIMENSIONS
    ),
)
def outcome_counters(spark, folder):
    return counters(read_table(spark, folder, "events"))


@query(
    "agg9_review_mix",
    """SELECT CASE WHEN user_id % 2 = 0 THEN 'first' ELSE 'second' END AS provider, count(*) FILTER (event_type IN ('click', 'view')) AS completed,
              count(*) FILTER (event_type IN ('error', 'signup')) AS fallback, count(*) FILTER (event_type = 'purchase') AS cache
       FROM events GROUP BY 1""",
)
def review_mix(spark, folder):
    kind = F.col("event_type")
    outcome = F.when(kind.isin("click", "view"), "completed").when(kind == "purchase", "cache").otherwise("fallback")
    provider = F.when(F.col("user_id") % 2 == 0, "first").otherwise("second")
    rows = read_table(spark, folder, "events").select(provider.alias("provider"), outcome.alias("outcome"))
    return rows.groupBy("provider").pivot("outcome", ["completed", "fallback", "cache"]).count().na.fill(0)


_CATALOGUE = dim_sql(library.LESSON_COLUMNS, library.LESSONS)
_DONE = "SELECT DISTINCT user_id, CAST(event_id % 15 + 1 AS INTEGER) AS ord FROM events WHERE event_type IN ('purchase', 'view')"


def completed(events):
    """(user, lesson number) of every lesson a user has finished."""
    return events.where(F.col("event_type").isin("purchase", "view")).select(
        "user_id", (F.col("event_id") % 15 + 1).cast("int").alias("ord")
    ).distinct()


@query(
    "agg10_learning_progress",
    f"""WITH c AS ({_CATALOGUE}), d AS ({_DONE}), u AS (SELECT DISTINCT user_id FROM events)
        SELECT u.user_id, least(count(d.ord), 500) AS n_completed, round(count(d.ord) / 15.0, 4) AS fraction,
               min(c.ord) FILTER (d.ord IS NULL) AS next_ord, coalesce(arg_min(c.lesson_id, c.ord) FILTER (d.ord IS NULL), '') AS next_lesson
        FROM u CROSS JOIN c LEFT JOIN d ON d.user_id = u.user_id AND d.ord = c.ord GROUP BY u.user_id""",
)
def learning_progress(spark, folder):
    """The finished set per user is at most the catalogue, so it is a small bounded array."""
    events = read_table(spark, folder, "events")
    finished = F.col("event_type").isin("purchase", "view")
    per = events.groupBy("user_id").agg(
        F.collect_set(F.when(finished, (F.col("event_id") % 15 + 1).cast("int"))).alias("done")
    )
    names = F.array(*[F.lit(lesson[1]) for lesson in library.LESSONS])
    catalogue = F.array(*[F.lit(lesson[0]) for lesson in library.LESSONS])
    first_open = F.array_min(F.array_except(catalogue, F.col("done")))
    return per.select(
        "user_id", F.least(F.size("done"), F.lit(500)).cast("bigint").alias("n_completed"),
        F.round(F.size("done") / len(library.LESSONS), 4).alias("fraction"), first_open.alias("next_ord"),
        F.coalesce(F.get(names, first_open - 1), F.lit("")).alias("next_lesson"),
    )


@query(
    "agg11_catalogue_filter",
    """SELECT lang, count(*) AS n_all, count(*) FILTER (contains(lower(text), 'licen')) AS n_licence, count(*) FILTER (NOT contains(lower(text), 'licen')) AS n_plain,
              count(*) FILTER (contains(lower(text), 'token') OR contains(lower(text), 'secret')) AS n_found FROM documents GROUP BY lang""",
)
def catalogue_filter(spark, folder):
    low = F.lower("text")
    return messages.documents(spark, folder).groupBy("lang").agg(
        F.count("*").alias("n_all"), F.count_if(low.contains("licen")).alias("n_licence"),
        F.count_if(~low.contains("licen")).alias("n_plain"),
        F.count_if(low.contains("token") | low.contains("secret")).alias("n_found"),
    )


@query(
    "agg12_sources_first_seen",
    f"""WITH {FINDINGS}, s AS (SELECT msg_id, rule_no, unnest(source_ids) AS source_id, generate_subscripts(source_ids, 1) AS place FROM f JOIN ({rules.rules_dim_sql()}) USING (rule_id))
        SELECT msg_id, string_agg(source_id, ',' ORDER BY first_seen) AS sources FROM (
          SELECT msg_id, source_id, min(rule_no * 100 + place) AS first_seen FROM s GROUP BY ALL) GROUP BY msg_id""",
)
def sources_first_seen(spark, folder):
    """Distinct sources in the order their rules are declared; at most one entry per rule and source."""
    found = rules.findings(messages.templated(spark, folder).select("msg_id", "text"), with_mask=False)
    cited = found.select("msg_id", "rule_no", "rule_id").join(rules.rules_dim(spark).select("rule_id", "source_ids"), "rule_id")
    ordered = F.array_sort(F.collect_list(F.struct("rule_no", "source_ids")))
    lists = cited.groupBy("msg_id").agg(ordered.alias("l"))
    return lists.select(
        "msg_id", F.array_join(F.array_distinct(F.flatten(F.transform("l", lambda x: x["source_ids"]))), ",").alias("sources")
    )


@query(
    "set3_unfinished_lessons",
    f"""WITH c AS ({_CATALOGUE}), d AS ({_DONE}), u AS (SELECT DISTINCT user_id FROM events)
        SELECT u.user_id, c.lesson_id FROM u CROSS JOIN c ANTI JOIN d ON d.user_id = u.user_id AND d.ord = c.ord""",
)
def unfinished_lessons(spark, folder):
    events = read_table(spark, folder, "events")
    catalogue = F.array(*[F.struct(F.lit(x[0]).alias("ord"), F.lit(x[1]).alias("lesson_id")) for x in library.LESSONS])
    wanted = events.select("user_id").distinct().select("user_id", F.explode(catalogue).alias("c")).select("user_id", "c.*")
    return wanted.join(completed(events), ["user_id", "ord"], "left_anti").select("user_id", "lesson_id")
