"""Merging, overlays, grounding, decisions, catalogue joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.dims import dim, dim_sql
from assayer.core.regex import has_sql
from assayer.core.session import read_table, settle
from assayer.operators import retrieval, review, rules
from assayer.packs import library, templates
from assayer.packs import rules as pack
from assayer.plans.catalog import query
from assayer.plans.oracle_parts import FINDINGS, M, RISK
from assayer.plans.retrieval_sql import CARDS, RETRIEVED
from assayer.sources import messages

_KNOWN_RULES = tuple(r.rule_id for r in pack.RULES)
_GROUNDED = f"""{CARDS}, {review.PROPOSALS_SQL},
ground AS (SELECT msg_id, rule_id, arg_min(excerpt, idx) AS excerpt, min(idx) AS idx FROM (
  SELECT p.msg_id, p.idx, p.category AS rule_id, p.excerpt FROM proposals p JOIN m USING (msg_id)
  WHERE p.category IN {_KNOWN_RULES} AND contains(text, p.excerpt) AND length(trim(p.excerpt)) >= 6 AND length(p.excerpt) <= 300
    AND NOT EXISTS (SELECT 1 FROM f WHERE f.msg_id = p.msg_id AND f.rule_id = p.category)) GROUP BY ALL)"""


def _m(spark, folder):
    return messages.templated(spark, folder)


def _local(m):
    """Findings made here, written once: the queries below read them two or three times, and a screening run is far dearer."""
    return settle(rules.findings(m.select("msg_id", "text"), with_mask=False), "local-findings")


def _online(m, local):
    """Grounded proposals as findings of the second opinion, plus its own view of guarantees."""
    meta = rules.rules_dim(m.sparkSession).select("rule_id", "severity")
    extra = review.grounded(m, review.derived_proposals(m), local).join(meta, "rule_id").select(
        "msg_id", "rule_id", "severity", F.lit("ai").alias("origin"), "excerpt"
    )
    again = local.where("rule_id = 'guarantee'").select(
        "msg_id", "rule_id", "severity", F.lit("ai").alias("origin"), F.lit("second view").alias("excerpt")
    )
    return extra.unionByName(again)


_ONLINE = f"""online AS (SELECT msg_id, rule_id, severity, 'ai' AS origin, excerpt FROM ground JOIN ({rules.rules_dim_sql()}) USING (rule_id)
  UNION ALL SELECT msg_id, rule_id, severity, 'ai', 'second view' FROM f WHERE rule_id = 'guarantee')"""


@query(
    "jn7_merge_finding_sets",
    f"""WITH {FINDINGS}, {_GROUNDED}, {_ONLINE}
        SELECT coalesce(f.msg_id, o.msg_id) AS msg_id, coalesce(f.rule_id, o.rule_id) AS rule_id,
               CASE WHEN f.msg_id IS NULL THEN o.severity ELSE f.severity END AS severity,
               CASE WHEN f.msg_id IS NULL THEN o.origin ELSE f.origin END AS origin,
               CASE WHEN f.msg_id IS NULL THEN o.excerpt ELSE 'local' END AS excerpt
        FROM f FULL OUTER JOIN online o ON f.msg_id = o.msg_id AND f.rule_id = o.rule_id""",
)
def merge_finding_sets(spark, folder):
    m = _m(spark, folder)
    local = _local(m).withColumn("excerpt", F.lit("local"))
    return review.merge_findings(local, _online(m, local))


@query(
    "jn7_merged_status",
    f"""WITH {FINDINGS}, {_GROUNDED}, {_ONLINE},
        merged AS (SELECT coalesce(f.msg_id, o.msg_id) AS msg_id, coalesce(f.rule_id, o.rule_id) AS rule_id,
                          CASE WHEN f.msg_id IS NULL THEN o.severity ELSE f.severity END AS severity
                   FROM f FULL OUTER JOIN online o ON f.msg_id = o.msg_id AND f.rule_id = o.rule_id),
        listed AS (SELECT msg_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
                   FROM (SELECT msg_id, unnest(source_ids) AS source FROM merged JOIN ({rules.rules_dim_sql()}) USING (rule_id)) GROUP BY msg_id)
        SELECT m.msg_id, count(x.rule_id) AS n_findings, CASE WHEN bool_or(x.severity = 'attention') THEN 'attention' ELSE 'context' END AS status,
               coalesce(any_value(l.sources), '') AS sources
        FROM m LEFT JOIN merged x USING (msg_id) LEFT JOIN listed l USING (msg_id) GROUP BY m.msg_id""",
)
def merged_status(spark, folder):
    m = _m(spark, folder)
    local = _local(m).withColumn("excerpt", F.lit("local"))
    return review.merged_status(m, review.merge_findings(local, _online(m, local)))


@query(
    "jn7_merged_purpose",
    f"""WITH {M} SELECT local_purpose, online_purpose, merged, count(*) AS n FROM (
        SELECT local_purpose, online_purpose, CASE WHEN local_purpose = 'mixed' OR online_purpose = 'mixed'
             OR (local_purpose = 'promotional' AND online_purpose = 'educational') OR (local_purpose = 'educational' AND online_purpose = 'promotional') THEN 'mixed'
             WHEN local_purpose <> 'unclear' THEN local_purpose ELSE online_purpose END AS merged
        FROM (SELECT CASE WHEN {has_sql('text', pack.ATOMS['offer'])} THEN 'promotional' WHEN {has_sql('text', pack.EXPLANATORY)} THEN 'educational' ELSE 'unclear' END AS local_purpose,
                     purpose AS online_purpose FROM m)) GROUP BY ALL""",
)
def merged_purpose(spark, folder):
    text = F.col("text")
    local = F.when(text.rlike(pack.ATOMS["offer"]), "promotional").when(text.rlike(pack.EXPLANATORY), "educational").otherwise("unclear")
    both = _m(spark, folder).select(local.alias("local_purpose"), F.col("purpose").alias("online_purpose"))
    return both.groupBy(
        "local_purpose", "online_purpose",
        review.merged_purpose(F.col("local_purpose"), F.col("online_purpose")).alias("merged"),
    ).agg(F.count("*").alias("n"))


@query(
    "jn8_apply_withdrawals",
    f"""WITH {RISK} SELECT f.msg_id, f.rule_id, CASE WHEN m.msg_id IS NOT NULL AND severity = 'attention' AND mr.level <> 'strong' THEN 'context' ELSE severity END AS severity
        FROM f LEFT JOIN (SELECT msg_id, theme FROM m WHERE CASE WHEN expected THEN msg_id % 7 = 1 ELSE msg_id % 7 <> 0 END
                            AND text NOT LIKE 'Ignore all previous instructions%') m ON m.msg_id = f.msg_id AND m.theme = f.rule_id
        JOIN mr ON mr.msg_id = f.msg_id""",
)
def apply_withdrawals(spark, folder):
    m = _m(spark, folder)
    local = _local(m)
    completed = F.when(F.col("expected"), F.col("msg_id") % 7 == 1).otherwise(F.col("msg_id") % 7 != 0)
    withdrawals = m.select("msg_id", F.col("theme").alias("rule_id"), "text", completed.alias("completed"))
    return review.apply_withdrawals(local, withdrawals, rules.risk(local)).select("msg_id", "rule_id", "severity")


@query(
    "jn9_valid_citations",
    f"""WITH {M}, {RETRIEVED}, {review.PROPOSALS_SQL}
        SELECT msg_id, idx, category FROM (
          SELECT p.msg_id, p.idx, p.category, count(*) AS n, count(DISTINCT p.card_id) AS d, bool_and(k.msg_id IS NOT NULL) AS ok
          FROM (SELECT msg_id, idx, category, unnest(evidence_ids) AS card_id FROM proposals) p
          LEFT JOIN retrieved k ON k.msg_id = p.msg_id AND k.card_id = p.card_id AND list_contains(k.category_ids, p.category)
          GROUP BY ALL) WHERE n <= 3 AND n = d AND ok""",
)
def valid_citations(spark, folder):
    m = _m(spark, folder)
    return review.valid_citations(review.derived_proposals(m), retrieval.retrieve_cards(m.select("msg_id", "text")))


@query("jn10_grounded_proposals", f"WITH {FINDINGS}, {_GROUNDED} SELECT msg_id, rule_id, idx, excerpt FROM ground")
def grounded_proposals(spark, folder):
    m = _m(spark, folder)
    return review.grounded(m, review.derived_proposals(m), rules.findings(m.select("msg_id", "text"), with_mask=False))


@query(
    "jn11_two_pass_decisions",
    f"""WITH {M}, {CARDS}, {review.PROPOSALS_SQL}
        SELECT msg_id, n_confirmed, n_confirmed = 0 AS withdrawals_stand FROM (
          SELECT d.msg_id, count(*) AS n_decided, count(DISTINCT d.idx) AS n_distinct, count(*) FILTER (decision = 'confirm') AS n_confirmed,
                 bool_and(p.msg_id IS NOT NULL) AS known
          FROM decisions d LEFT JOIN proposals p ON p.msg_id = d.msg_id AND p.idx = d.idx GROUP BY d.msg_id)
        JOIN (SELECT msg_id, count(*) AS n_asked FROM proposals GROUP BY msg_id) USING (msg_id)
        WHERE n_decided = n_asked AND n_distinct = n_asked AND known""",
)
def two_pass_decisions(spark, folder):
    m = _m(spark, folder)
    return review.decide(review.derived_proposals(m), review.derived_decisions(m))


_REVIEWED = dim_sql("template_id, purpose, reason", templates.REVIEWED_PURPOSE)


@query(
    "jn13_purpose_overlay",
    f"""WITH {M}, rp AS ({_REVIEWED}) SELECT coalesce(rp.purpose, m.purpose) AS purpose, rp.purpose IS NOT NULL AS reviewed, count(*) AS n
        FROM m LEFT JOIN rp USING (template_id) GROUP BY ALL""",
)
def purpose_overlay(spark, folder):
    decided = dim(spark, "template_id, purpose, reason", templates.REVIEWED_PURPOSE).select(
        "template_id", F.col("purpose").alias("decided")
    )
    joined = _m(spark, folder).join(decided, "template_id", "left")
    return joined.groupBy(
        F.coalesce("decided", "purpose").alias("purpose"), F.col("decided").isNotNull().alias("reviewed")
    ).agg(F.count("*").alias("n"))


_TAGS = " UNION ALL ".join(
    f"SELECT origin, id, '{c}' AS lesson_id FROM asked WHERE {has_sql('text', p)}" for c, p in pack.CONCEPTS
)


@query(
    "jn15_questions_to_lessons",
    f"""WITH {M}, asked AS (SELECT 'turn' AS origin, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'message', msg_id, text FROM m),
        tags AS ({_TAGS}), les AS ({dim_sql(library.LESSON_COLUMNS, library.LESSONS)})
        SELECT lesson_id, title, count(*) AS n_questions FROM tags JOIN les USING (lesson_id) GROUP BY ALL
        UNION ALL SELECT 'unmatched', origin, count(*) FROM asked WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.origin = asked.origin AND t.id = asked.id) GROUP BY ALL""",
)
def questions_to_lessons(spark, folder):
    """Lessons asked for by conversation turns and messages; unmatched questions are counted per origin."""
    turns = read_table(spark, folder, "conversations").select(F.lit("turn").alias("origin"), "text")
    asked = turns.unionByName(_m(spark, folder).select(F.lit("message").alias("origin"), "text"))
    tags = rules.all_concepts(F.col("text"))
    lessons = dim(spark, library.LESSON_COLUMNS, library.LESSONS).select("lesson_id", "title")
    # A question without tags keeps one empty row, so both answers come from one pass. The counts are few; they are
    # written, as a filter on them would else go down into the texts' step and that step be made twice.
    counted = settle(
        asked.select("origin", F.explode_outer(tags).alias("lesson_id")).groupBy("origin", "lesson_id").agg(F.count("*").alias("n")),
        "concept-counts",
    )
    matched = counted.join(lessons, "lesson_id").groupBy("lesson_id", "title").agg(F.sum("n").alias("n_questions"))
    missed = counted.where("lesson_id IS NULL").select(
        F.lit("unmatched").alias("lesson_id"), F.col("origin").alias("title"), F.col("n").alias("n_questions")
    )
    return matched.unionByName(missed)
