"""Audits of texts, references, pairs, masking and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.dims import dim, dim_sql
from assayer.core.dims import sql_literal as q
from assayer.core.regex import has_sql
from assayer.core.session import read_table
from assayer.functions import text as t
from assayer.operators import quality, rules
from assayer.packs import lexicon, templates, wording
from assayer.packs import rules as pack
from assayer.plans.catalog import query
from assayer.plans.oracle_parts import FINDINGS, M
from assayer.plans.queries_text import census
from assayer.sources import messages

@query(
    "dq1_expectations",
    """SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 12 THEN 'too short' END, CASE WHEN length(text) > 6000 THEN 'too long' END,
              CASE WHEN lang NOT IN ('en', 'hi', 'bn') THEN 'language' END, CASE WHEN n_chars <> length(text) THEN 'size' END,
              CASE WHEN NOT regexp_matches(source, '^src[0-9]+$') THEN 'source' END) AS reasons
       FROM documents WHERE length(text) < 12 OR length(text) > 6000 OR lang NOT IN ('en', 'hi', 'bn') OR n_chars <> length(text) OR NOT regexp_matches(source, '^src[0-9]+$')""",
)
def expectations(spark, folder):
    size = F.length("text")
    checks = {
        "too short": size >= t.MESSAGE_MINIMUM,
        "too long": size <= t.MESSAGE_LIMIT,
        "language": F.col("lang").isin("en", "hi", "bn"),
        "size": F.col("n_chars") == size,
        "source": F.col("source").rlike("^src[0-9]+$"),
    }
    bad = quality.violations(read_table(spark, folder, "documents"), "doc_id", checks)
    return bad.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "dq2_repeated_texts",
    "SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
)
def repeated_texts(spark, folder):
    return quality.repeated(read_table(spark, folder, "documents"), F.sha2("text", 256), "doc_id")


_EDGES = [
    ("labels to documents", "labels", "doc_id", "documents", "doc_id"),
    ("orders to customers", "orders", "o_custkey", "customer", "c_custkey"),
    ("events to customers", "events", "user_id", "customer", "c_custkey"),
    ("documents to labels", "documents", "doc_id", "labels", "doc_id"),
    ("turns to documents", "conversations", "conv_id", "documents", "doc_id"),
]


@query(
    "dq3_references",
    " UNION ALL ".join(
        f"SELECT '{edge}' AS edge, count(*) AS n_refs, count(*) FILTER ({col} NOT IN (SELECT {key} FROM {parent})) AS n_dangling FROM {child}"
        for edge, child, col, parent, key in _EDGES
    ),
)
def references(spark, folder):
    out = None
    for edge, child, column, parent, key in _EDGES:
        one = quality.dangling(read_table(spark, folder, child), column, read_table(spark, folder, parent), key, edge)
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dq4_contrast_pairs",
    f"""WITH {M} SELECT theme, lang, count(*) AS n_pairs, count(*) FILTER (NOT sound) AS n_unsound FROM (
        SELECT min(theme) AS theme, min(lang) AS lang, count(*) FILTER (expected) = 1 AND count(*) FILTER (NOT expected) = 1 AND count(DISTINCT theme) = 1 AS sound
        FROM m GROUP BY round_id, pair_id) GROUP BY ALL""",
)
def contrast_pairs(spark, folder):
    pairs = messages.templated(spark, folder).groupBy("round_id", "pair_id").agg(
        F.min("theme").alias("theme"), F.min("lang").alias("lang"),
        ((F.count_if("expected") == 1) & (F.count_if(~F.col("expected")) == 1) & (F.count_distinct("theme") == 1)).alias("sound"),
    )
    return pairs.groupBy("theme", "lang").agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("sound")).alias("n_unsound"))


_REVIEWED = dim_sql("template_id, purpose, reason", templates.REVIEWED_PURPOSE)


@query(
    "dq5_derived_records",
    f"""WITH {M}, src AS ({dim_sql(templates.COLUMNS, templates.rows())}), rp AS ({_REVIEWED})
        SELECT 'label' AS field, count(*) FILTER (d.expected <> src.expected) AS n_apart, count(*) AS n FROM m d JOIN src USING (template_id)
        UNION ALL SELECT 'language', count(*) FILTER (d.lang <> src.lang), count(*) FROM m d JOIN src USING (template_id)
        UNION ALL SELECT 'theme', count(*) FILTER (d.theme <> src.theme), count(*) FROM m d JOIN src USING (template_id)
        UNION ALL SELECT 'purpose', count(*) FILTER (coalesce(rp.purpose, d.purpose) <> src.purpose), count(*) FROM m d JOIN src USING (template_id) LEFT JOIN rp USING (template_id)
        UNION ALL SELECT 'open placeholder', count(*) FILTER (contains(d.text, '{{')), count(*) FROM m d JOIN src USING (template_id)""",
)
def derived_records(spark, folder):
    """Messages against the source row they were derived from, field by field, in one pass."""
    src = dim(spark, templates.COLUMNS, templates.rows()).select(
        "template_id", *[F.col(c).alias(f"s_{c}") for c in ("lang", "theme", "expected", "purpose")]
    )
    decided = dim(spark, "template_id, purpose, reason", templates.REVIEWED_PURPOSE).select(
        "template_id", F.col("purpose").alias("decided")
    )
    joined = messages.templated(spark, folder).join(src, "template_id").join(decided, "template_id", "left")
    apart = {
        "label": F.col("expected") != F.col("s_expected"), "language": F.col("lang") != F.col("s_lang"),
        "theme": F.col("theme") != F.col("s_theme"),
        "purpose": F.coalesce("decided", "purpose") != F.col("s_purpose"),
        "open placeholder": F.col("text").contains("{"),
    }
    one = joined.agg(F.count("*").alias("n"), *[F.count_if(test).alias(name) for name, test in apart.items()])
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"`{name}`").alias("n_apart")) for name in apart])
    return one.select("n", F.explode(fields).alias("f")).select("f.field", "f.n_apart", "n")


@query(
    "dq6_translation_gaps",
    f"""WITH {M}, copy AS ({dim_sql(templates.COPY_COLUMNS, templates.COPY)})
        SELECT key, lang, count(*) AS n_messages FROM (SELECT CASE WHEN expected THEN 'attention' ELSE 'context' END AS key, string_split(lang, '-')[1] AS lang FROM m)
        ANTI JOIN copy USING (key, lang) GROUP BY ALL""",
)
def translation_gaps(spark, folder):
    """Messages whose reader-facing copy is missing in their own language."""
    copy = dim(spark, templates.COPY_COLUMNS, templates.COPY).select("key", "lang")
    needed = messages.templated(spark, folder).groupBy(
        F.when(F.col("expected"), "attention").otherwise("context").alias("key"),
        F.split_part("lang", F.lit("-"), F.lit(1)).alias("lang"),
    ).agg(F.count("*").alias("n_messages"))
    return needed.join(copy, ["key", "lang"], "left_anti")


def _found_sql(text: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {has_sql(text, e[4])} THEN '{e[0]}' END" for e in lexicon.LEXICON) + ")"


@query(
    "dq7_metamorphic_documents",
    " UNION ALL ".join(
        f"SELECT '{name}' AS perturbation, count(*) AS n, count(*) FILTER ({_found_sql('text')} <> {_found_sql(f'({sql})')}) AS n_changed FROM documents"
        for name, _, sql in quality.PERTURBATIONS
    ),
)
def metamorphic_documents(spark, folder):
    """Documents whose lexicon findings change under a formatting change, per change."""
    def found(text):
        return F.concat_ws(",", *[F.when(text.rlike(e[4]), e[0]) for e in lexicon.LEXICON])

    docs = messages.documents(spark, folder)
    forms = F.array(*[F.struct(F.lit(n).alias("perturbation"), fn(F.col("text")).alias("form")) for n, fn, _ in quality.PERTURBATIONS])
    each = docs.select(found(F.col("text")).alias("base"), F.explode(forms).alias("p")).select("base", "p.*")
    return each.groupBy("perturbation").agg(
        F.count("*").alias("n"), F.count_if(F.col("base") != found(F.col("form"))).alias("n_changed")
    )


@query("dq7_metamorphic_messages")
def metamorphic_messages(spark, folder):
    """Messages whose outcome changes under hidden characters, look-alikes or spelled acronyms: none should."""
    m = messages.templated(spark, folder).select("msg_id", "text")
    text = F.col("text")
    forms = {
        "zero-width": F.regexp_replace(text, "(?<=[a-z]{2})(?=[a-z]{2})", "\u200b"),
        "look-alike": F.translate(text, "aeo", "аео"),
        "spelled acronym": F.regexp_replace(F.regexp_replace(text, "OTP", "O T P"), "KYC", "K Y C"),
    }
    # A form that leaves the text as it is shares its outcome; the others are screened in rows of their own.
    kept = F.filter(F.array(*[F.when(form == text, F.lit(name)) for name, form in forms.items()]), lambda name: name.isNotNull())
    sent = F.struct(F.concat(F.array(F.lit("as sent")), kept).alias("forms"), text.alias("text"))
    other = F.array(*[F.struct(F.array(F.lit(name)).alias("forms"), form.alias("text")) for name, form in forms.items()])
    every = m.select("msg_id", F.explode(F.concat(F.array(sent), F.filter(other, lambda f: f["text"] != text))).alias("f")).select("msg_id", "f.*")
    warned = F.coalesce(F.exists("found", lambda f: f["severity"] == "attention"), F.lit(False))

    def outcome(name: str):
        return F.bool_or(F.array_contains("forms", name) & F.col("warned"))

    each = rules.judged(every).select("msg_id", "forms", warned.alias("warned")).groupBy("msg_id").agg(
        F.count_if(F.array_contains("forms", "as sent")).alias("n"), outcome("as sent").alias("before"),
        F.array(*[F.struct(F.lit(name).alias("perturbation"), outcome(name).alias("after")) for name in forms]).alias("forms"),
    )
    one = each.select("msg_id", "n", "before", F.explode("forms").alias("f")).select("*", "f.*")
    apart = F.col("msg_id").isNotNull() & (F.col("after") != F.col("before"))
    return one.groupBy("perturbation").agg(F.sum("n").alias("n"), F.sum(F.when(apart, F.col("n")).otherwise(0)).alias("n_changed"))


@query(
    "dq8_masking_leaks",
    " UNION ALL ".join(
        f"SELECT {q(d[0])} AS kind, CAST(0 AS BIGINT) AS n_messages, CAST(0 AS BIGINT) AS n_hits FROM (SELECT 1 FROM documents LIMIT 1)"
        for d in wording.DETECTORS
    ),
)
def masking_leaks(spark, folder):
    """Detectors run again over masked documents and messages: every count must be zero."""
    docs = messages.documents(spark, folder).select("text")
    both = docs.unionByName(messages.templated(spark, folder).select("text"))
    return census(both.select(t.masked(F.col("text")).alias("text")))


@query(
    "dq8_masking_is_idempotent",
    "SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM orders) AS n, CAST(0 AS BIGINT) AS n_changed",
)
def masking_is_idempotent(spark, folder):
    docs = messages.documents(spark, folder).select("text")
    both = docs.unionByName(messages.templated(spark, folder).select("text"))
    once = both.select(t.masked(F.col("text")).alias("once"))
    return once.select("once", t.masked(F.col("once")).alias("twice")).agg(
        F.count("*").alias("n"), F.count_if(F.col("once") != F.col("twice")).alias("n_changed")
    )


@query(
    "dq9_finding_invariants",
    f"""WITH {FINDINGS} SELECT count(*) AS n, count(*) FILTER (NOT contains(m.text, f.original)) AS n_not_quoted,
               count(*) FILTER (severity NOT IN ('attention', 'context')) AS n_bad_severity,
               count(*) FILTER (rule_id NOT IN {tuple(r.rule_id for r in pack.RULES)}) AS n_unknown_rule,
               (SELECT count(*) FROM (SELECT msg_id FROM f GROUP BY msg_id HAVING count(*) > 32)) AS n_too_many
        FROM (SELECT f.*, h.original FROM f JOIN hits h USING (msg_id, clause_no, rule_id)) f JOIN m USING (msg_id)""",
)
def finding_invariants(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    found = rules.findings(m, with_mask=False)
    sized = found.groupBy("msg_id").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("severity").isin("attention", "context")).alias("bad"),
        F.count_if(~F.col("rule_id").isin(*[r.rule_id for r in pack.RULES])).alias("unknown"),
        F.collect_list("excerpt").alias("excerpts"),
    )
    checked = sized.join(m, "msg_id").select(
        "*", F.size(F.filter("excerpts", lambda e: ~F.contains(F.col("text"), e))).alias("loose")
    )
    total = [F.sum("n").alias("n"), F.sum("loose").cast("bigint").alias("n_not_quoted"), F.sum("bad").alias("n_bad_severity"),
             F.sum("unknown").alias("n_unknown_rule"), F.count_if(F.col("n") > 32).alias("n_too_many")]
    return checked.agg(*total)
