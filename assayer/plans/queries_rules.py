"""Rule matching from theta join to risk tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.dims import dim, dim_sql
from assayer.core.regex import has_sql
from assayer.operators import retrieval, rules
from assayer.operators.clauses import clauses_sql
from assayer.packs import lexicon, library
from assayer.packs import rules as pack
from assayer.plans import screening
from assayer.plans.catalog import query
from assayer.plans.oracle_parts import FINDINGS, HITS, RISK
from assayer.plans.retrieval_sql import CARDS, tokens_sql
from assayer.sources import messages

_LEX = dim_sql(lexicon.COLUMNS, lexicon.LEXICON)
_LEX_HITS = f"""dc AS ({clauses_sql("(SELECT doc_id AS msg_id, lang, text FROM documents)", conjunctions=False)}),
lex AS ({_LEX}), lh AS (SELECT msg_id, lang, clause_no, clause, rule_id, family, severity, is_action FROM dc JOIN lex ON regexp_matches(clause, pattern))"""


@query("jn1_clauses_by_lexicon", f"WITH {_LEX_HITS} SELECT msg_id, clause_no, rule_id FROM lh")
def clauses_by_lexicon(spark, folder):
    return screening.lexicon_hits(messages.documents(spark, folder)).select("msg_id", "clause_no", "rule_id")


@query(
    "jn1_word_lexicon",
    f"""WITH w AS ({dim_sql("token, kind", lexicon.WORDS)}) SELECT kind, token, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n
        FROM ({tokens_sql('documents', 'doc_id').replace('NOT list_contains', 'true OR NOT list_contains')}) JOIN w USING (token) GROUP BY ALL""",
)
def word_lexicon(spark, folder):
    """A lexicon of plain words meets the tokens on an equi-join instead of patterns."""
    words = dim(spark, "token, kind", lexicon.WORDS)
    docs = messages.documents(spark, folder)
    said = docs.select(
        "msg_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("token")
    )
    per = said.join(words, "token").groupBy("msg_id", "token", "kind").agg(F.count("*").alias("tf"))
    return per.groupBy("kind", "token").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


@query("jn1_rule_hits", f"WITH {HITS} SELECT msg_id, clause_no, rule_id FROM hits")
def rule_hits(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    return rules.rule_hits(rules.screened_clauses(m)).select("msg_id", "clause_no", "rule_id")


_GATED = [r.rule_id for r in pack.RULES if r.rule_id in pack.CONTEXT_GATES]


@query(
    "jn2_context_gate",
    f"""WITH {HITS} SELECT h.msg_id, h.clause_no, h.rule_id FROM hits h WHERE rule_id NOT IN {tuple(_GATED)}
        OR EXISTS (SELECT 1 FROM m WHERE m.msg_id = h.msg_id AND CASE h.rule_id {' '.join(f"WHEN '{g}' THEN {has_sql('m.text', pack.CONTEXT_GATES[g])}" for g in _GATED)} END)""",
)
def context_gate(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    return rules.rule_hits(rules.screened_clauses(m)).where("in_context").select("msg_id", "clause_no", "rule_id")


@query(
    "jn3_without_cautions",
    f"""WITH {HITS} SELECT h.msg_id, h.clause_no, h.rule_id FROM hits h ANTI JOIN (
        {' UNION ALL '.join(f"SELECT msg_id, clause_no, '{rule}' AS rule FROM j WHERE {has_sql('w_det', p)} AND NOT {has_sql('w_det', u)}" for rule, _, _, p, u in pack.CAUTIONS)}
        ) x ON x.msg_id = h.msg_id AND x.clause_no = h.clause_no AND (x.rule = '*' OR x.rule = h.rule_id)""",
)
def without_cautions(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    return rules.rule_hits(rules.screened_clauses(m)).where("NOT cautioned").select("msg_id", "clause_no", "rule_id")


@query(
    "jn4_first_match",
    f"WITH {FINDINGS} SELECT msg_id, rule_id, clause_no, severity, soliciting, excerpt FROM f",
)
def first_match(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    return rules.findings(m).select("msg_id", "rule_id", "clause_no", "severity", "soliciting", "excerpt")


_LESSON_SQL = dim_sql(library.LESSON_COLUMNS, library.LESSONS)


@query(
    "jn12_enriched_findings",
    f"""WITH {FINDINGS}, {CARDS}, rd AS ({rules.rules_dim_sql()}), les AS ({_LESSON_SQL}),
        fs AS (SELECT f.msg_id, f.rule_id, rd.concept_id, unnest(rd.source_ids) AS source_id FROM f JOIN rd USING (rule_id))
        SELECT msg_id, string_agg(DISTINCT fs.source_id, ',' ORDER BY fs.source_id) AS sources,
               string_agg(DISTINCT card_id, ',' ORDER BY card_id) AS cards, string_agg(DISTINCT title, ',' ORDER BY title) AS lessons
        FROM fs LEFT JOIN (SELECT card_id, source_id, unnest(category_ids) AS rule_id FROM cards) c USING (rule_id, source_id)
        LEFT JOIN (SELECT lesson_id, title FROM les) ON lesson_id = concept_id GROUP BY msg_id""",
)
def enriched(spark, folder):
    found = rules.findings(messages.templated(spark, folder).select("msg_id", "text"), with_mask=False)
    meta = rules.rules_dim(spark).select("rule_id", "concept_id", F.explode("source_ids").alias("source_id"))
    cards = retrieval.cards(spark).select("card_id", "source_id", F.explode("category_ids").alias("rule_id"))
    lessons = dim(spark, library.LESSON_COLUMNS, library.LESSONS).select(F.col("lesson_id").alias("concept_id"), "title")
    # Every name set is bounded by the fixed library, so the collected sets stay small.
    guide = meta.join(cards, ["rule_id", "source_id"], "left").join(lessons, "concept_id", "left")
    joined = found.select("msg_id", "rule_id").join(guide, "rule_id")

    def names(column):
        return F.array_join(F.array_sort(F.collect_set(column)), ",")

    return joined.groupBy("msg_id").agg(
        names("source_id").alias("sources"), F.nullif(names("card_id"), F.lit("")).alias("cards"), names("title").alias("lessons")
    )


@query(
    "agg1_risk_tiers",
    f"WITH {RISK} SELECT msg_id, level, reasons, n_findings FROM mr",
)
def risk_tiers(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    return rules.tiers(m).select("msg_id", "level", F.array_join("reason_ids", ",").alias("reasons"), "n_findings")


@query(
    "agg2_status_and_summary",
    f"""WITH {RISK} SELECT status, summary, count(*) AS n FROM (
        SELECT CASE WHEN n_reasons > 0 THEN 'attention' ELSE 'context' END AS status,
               CASE WHEN n_reasons > 0 THEN 'pause' WHEN n_findings > 0 THEN 'more context' ELSE 'not enough evidence' END AS summary
        FROM mr) GROUP BY ALL""",
)
def status_and_summary(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    warned = F.size("reason_ids") > 0
    return rules.tiers(m).groupBy(
        F.when(warned, "attention").otherwise("context").alias("status"),
        F.when(warned, "pause").when(F.col("n_findings") > 0, "more context").otherwise("not enough evidence").alias("summary"),
    ).agg(F.count("*").alias("n"))


@query(
    "flagship_document_screening",
    f"""WITH {_LEX_HITS},
        t AS (SELECT d.lang, CASE WHEN n_families >= 2 AND acts THEN 'strong' WHEN n_families >= 1 THEN 'potential' ELSE 'insufficient' END AS level
              FROM documents d LEFT JOIN (SELECT msg_id, count(DISTINCT family) FILTER (severity = 'attention') AS n_families,
                    bool_or(severity = 'attention' AND is_action) AS acts FROM lh GROUP BY msg_id) ON msg_id = doc_id)
        SELECT coalesce(lang, 'ALL') AS lang, coalesce(level, 'ALL') AS level, count(*) AS n FROM t GROUP BY ROLLUP (lang, level)""",
)
def document_screening(spark, folder):
    return screening.tier_rollup(screening.lexicon_tiers(messages.documents(spark, folder)))
