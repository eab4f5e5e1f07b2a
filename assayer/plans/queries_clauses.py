"""The clause model: splits, quotes, joins, cautions, requests, corroboration."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.dims import sql_literal as q
from assayer.core.regex import has_sql, positions
from assayer.core.session import settle
from assayer.operators import clauses as c
from assayer.operators import rules
from assayer.packs import rules as pack
from assayer.plans.catalog import query
from assayer.plans.oracle_parts import CLAUSES, FINDINGS, HITS, JOINED, M
from assayer.sources import messages

_DOCS = "(SELECT doc_id AS msg_id, text FROM documents)"


@query(
    "cls1_split_sentences",
    f"""SELECT msg_id, clause_no, start, "end", clause FROM ({c.clauses_sql(_DOCS, conjunctions=False)})""",
)
def split_sentences(spark, folder):
    docs = messages.documents(spark, folder).select("msg_id", "text")
    exploded = docs.select("msg_id", F.posexplode(c.clause_array(F.col("text"), False)).alias("clause_no", "c"))
    return exploded.select("msg_id", "clause_no", "c.start", "c.end", "c.clause")


@query(
    "cls2_split_conjunctions",
    f"""WITH {M} SELECT msg_id, clause_no, start, "end", clause FROM ({c.clauses_sql('m')})""",
)
def split_conjunctions(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    exploded = m.select("msg_id", F.posexplode(c.clause_array(F.col("text"))).alias("clause_no", "c"))
    return exploded.select("msg_id", "clause_no", "c.start", "c.end", "c.clause")


@query(
    "cls3_quoted_spans",
    f"""SELECT msg_id, CAST(ord AS INTEGER) AS quote_no, pos, hit AS quote FROM (
        SELECT msg_id, ord, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY msg_id ORDER BY ord) - length(hit) AS BIGINT) AS pos
        FROM (SELECT msg_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) - 1 AS ord
              FROM (SELECT msg_id, regexp_extract_all(text, {q(c.QUOTE)}) AS hits, regexp_split_to_array(text, {q(c.QUOTE)}) AS gaps FROM {_DOCS})))""",
)
def quoted_spans(spark, folder):
    docs = messages.documents(spark, folder)
    return docs.select("msg_id", F.posexplode(positions(F.col("text"), c.QUOTE)).alias("quote_no", "h")).select(
        "msg_id", "quote_no", "h.pos", F.col("h.hit").alias("quote")
    )


@query("cls3_blank_rejected_quotes", f"WITH {M} SELECT msg_id, quiet FROM m")
def blank_rejected_quotes(spark, folder):
    return messages.templated(spark, folder).select("msg_id", c.quote_masked(F.col("text")).alias("quiet"))


@query("cls3_blank_rejected_quotes_documents")
def blank_rejected_quotes_documents(spark, folder):
    docs = messages.documents(spark, folder).select("msg_id", "text", c.quote_masked(F.col("text")).alias("quiet"))
    return docs.groupBy("msg_id").agg(
        F.max(F.length("text")).alias("n_chars"), F.max(F.length("quiet")).alias("n_quiet"),
        F.bool_or(F.col("text") != F.col("quiet")).alias("changed"),
    )


def _joined(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    return c.joined_clauses(c.split_clauses(m, mask_quotes=True), rules.cautioned)


@query(
    "cls4_join_dependent_clauses",
    f"WITH {JOINED} SELECT msg_id, clause_no, coalesce(joined_by, '') AS joined_by, w_start, w_end FROM j",
)
def join_dependent(spark, folder):
    return _joined(spark, folder).select(
        "msg_id", "clause_no", F.coalesce("joined_by", F.lit("")).alias("joined_by"), "w_start", "w_end"
    )


_NEAR = ("coalesce(prev_det, '')", "coalesce(next_det, '')")


@query(
    "cls5_ordinary_deadlines",
    f"""WITH {CLAUSES} SELECT msg_id, clause_no, {rules.ordinary_deadline_sql('det', *_NEAR)} AS ordinary
        FROM cl WHERE {has_sql('det', pack.ATOMS['deadline'])}""",
)
def ordinary_deadlines(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    cl = c.split_clauses(m, mask_quotes=True).where(F.col("det").rlike(pack.ATOMS["deadline"]))
    near = [F.coalesce(n, F.lit("")) for n in ("prev_det", "next_det")]
    return cl.select("msg_id", "clause_no", rules.ordinary_deadline(F.col("det"), *near).alias("ordinary"))


@query(
    "cls6_cautions",
    f"WITH {CLAUSES} "
    + " UNION ALL ".join(
        f"SELECT msg_id, clause_no, {q(rule)} AS rule_id, {no} AS caution_no, {q(kind)} AS kind FROM cl "
        f"WHERE {has_sql('det', pattern)} AND NOT {has_sql('det', unless)}"
        for rule, no, kind, pattern, unless in pack.CAUTIONS
    ),
)
def cautions(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    det = F.col("det")
    found = F.array_compact(F.array(*[
        F.when(det.rlike(pattern) & ~det.rlike(unless),
               F.struct(F.lit(rule).alias("rule_id"), F.lit(no).alias("caution_no"), F.lit(kind).alias("kind")))
        for rule, no, kind, pattern, unless in pack.CAUTIONS
    ]))
    return c.split_clauses(m, mask_quotes=True).select("msg_id", "clause_no", F.explode(found).alias("k")).select(
        "msg_id", "clause_no", "k.*"
    )


@query(
    "cls7_live_requests",
    f"WITH {HITS} SELECT msg_id, clause_no, rule_id FROM hits WHERE soliciting AND is_scoped",
)
def live_requests(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    scoped = [r.rule_id for r in pack.RULES if r.is_scoped]
    hits = rules.rule_hits(rules.screened_clauses(m))
    return hits.where(F.col("soliciting") & F.col("rule_id").isin(*scoped)).select("msg_id", "clause_no", "rule_id")


@query(
    "cls8_corroborated_findings",
    f"""WITH {FINDINGS} SELECT DISTINCT f.msg_id, f.rule_id FROM f JOIN hits h
        ON h.msg_id = f.msg_id AND h.rule_id = f.rule_id AND h.w_start < f.w_end AND h.w_end > f.w_start
        WHERE h.soliciting AND f.severity = 'attention'""",
)
def corroborated(spark, folder):
    """Findings whose span overlaps a live, uncautioned clause of the same rule.

    The spans meet on message and rule, so the overlap test only ever compares
    the few clauses of one message.
    """
    m = messages.templated(spark, folder).select("msg_id", "text")
    # Both come from one screening, written once.
    kept = ["rule_id", "w_start", "w_end"]
    screened = settle(rules.judged(m, hits=True).select(
        "msg_id",
        F.transform(F.filter("_hits", lambda h: h["soliciting"]), lambda h: F.struct(*[h[k].alias(k) for k in kept])).alias("live"),
        F.transform(F.filter("found", lambda f: f["severity"] == "attention"), lambda f: F.struct(*[f[k].alias(k) for k in kept])).alias("found"),
    ), "screened-spans")
    live = screened.select("msg_id", F.inline("live")).withColumnsRenamed({"w_start": "s", "w_end": "e"})
    found = screened.select("msg_id", F.inline("found"))
    overlap = (
        (found.msg_id == live.msg_id) & (found.rule_id == live.rule_id)
        & (live.s < found.w_end) & (live.e > found.w_start)
    )
    return found.join(live, overlap, "left_semi").select("msg_id", "rule_id")
