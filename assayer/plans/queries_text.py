"""Projections, filters and masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from assayer.core.dims import dim, dim_sql
from assayer.core.dims import sql_literal as q
from assayer.core.regex import has_sql
from assayer.core.session import read_table
from assayer.functions import text as t
from assayer.operators import rules
from assayer.packs import library, templates, wording
from assayer.packs import rules as pack
from assayer.plans.catalog import query
from assayer.plans.oracle_parts import FINDINGS, PHONE_FIRST, M
from assayer.sources import messages

_TRIM = "regexp_replace({}, '^[\\s\\x{{A0}}\\x{{FEFF}}\\p{{Zs}}]+|[\\s\\x{{A0}}\\x{{FEFF}}\\p{{Zs}}]+$', '', 'g')"


@query(
    "prj1_bound_and_trim",
    f"""SELECT msg_id, substr(whole, 1, 6000) AS text, length(whole) AS n_chars,
               CASE WHEN length(whole) < 12 THEN 'too short' WHEN length(whole) > 6000 THEN 'too long' ELSE 'kept' END AS status
        FROM (SELECT doc_id AS msg_id, {_TRIM.format('nfc_normalize(text)')} AS whole FROM documents)""",
)
def bound_and_trim(spark, folder):
    whole = messages.documents(spark, folder).select("msg_id", t.trimmed(t.nfkc(F.col("text"))).alias("whole"))
    size = F.length("whole")
    return whole.select(
        "msg_id",
        F.substring("whole", 1, t.MESSAGE_LIMIT).alias("text"),
        size.alias("n_chars"),
        messages.intake_status(size).alias("status"),
    )


@query("prj2_mask_personal_data", f"SELECT doc_id AS msg_id, {t.masked_sql('text')} AS masked FROM documents")
def mask_personal_data(spark, folder):
    return messages.documents(spark, folder).select("msg_id", t.masked(F.col("text")).alias("masked"))


@query("prj2_mask_templated", f"WITH {M} SELECT msg_id, {t.masked_sql('text', PHONE_FIRST)} AS masked FROM m")
def mask_templated(spark, folder):
    return messages.templated(spark, folder).select("msg_id", t.masked(F.col("text")).alias("masked"))


def _census_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {q(d[0])} AS kind, count(*) FILTER (n > 0) AS n_messages, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_hits "
        f"FROM (SELECT length(x) - length(replace(x, chr(64976), '')) AS n FROM (SELECT {t.masked_sql('text', [d], chr(64976))} AS x FROM {source}))"
        for d in wording.DETECTORS
    )


def census(df):
    """Messages and hits per detector, in one pass over the text."""
    hits = df.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n")) for k, n in t.pii_hits(F.col("text"))])).alias("h")
    ).select("h.*")
    return hits.groupBy("kind").agg(F.count_if(F.col("n") > 0).alias("n_messages"), F.sum("n").alias("n_hits"))


@query("prj3_personal_data_census", _census_sql("documents"))
def personal_data_census(spark, folder):
    return census(messages.documents(spark, folder))


@query("prj3_personal_data_census_templated", f"WITH {M} {_census_sql('m')}")
def personal_data_census_templated(spark, folder):
    return census(messages.templated(spark, folder))


@query("prj4_detection_text")
def detection_text(spark, folder):
    return messages.documents(spark, folder).select("msg_id", t.detection_text(t.nfkc(F.col("text"))).alias("detection"))


@query(
    "prj4_detection_text_templated",
    f"WITH {M} SELECT msg_id, regexp_replace(replace(replace(text, 'ओटीपी', 'OTP'), 'ওটিপি', 'OTP'), '\\s+', ' ', 'g') AS detection FROM m",
)
def detection_text_templated(spark, folder):
    return messages.templated(spark, folder).select("msg_id", t.detection_text(t.nfkc(F.col("text"))).alias("detection"))


_NATIVE = [("0123456789", "०१२३४५६७८९"), ("0123456789", "০১২৩৪৫৬৭৮৯"), ("0123456789", "０１２３４５６７８９")]


@query(
    "prj5_fold_digits",
    "SELECT o_orderkey, CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS folded FROM orders",
)
def fold_digits(spark, folder):
    """Order prices written in Devanagari, Bengali or full-width digits, read back."""
    price = F.floor(F.col("o_totalprice") * 100).cast("string")
    turn = F.col("o_orderkey") % len(_NATIVE)
    native = reduce(
        lambda acc, i: F.when(turn == i, F.translate(price, *_NATIVE[i])).otherwise(acc), range(len(_NATIVE)), price
    )
    orders = read_table(spark, folder, "orders").select("o_orderkey", native.alias("native"))
    return orders.select("o_orderkey", t.ascii_digits(F.col("native")).alias("folded"))


_SHOWN = ("token", "secret", "licensed", "erth")


def _display_sql(column: str) -> str:
    plain, spaced = t.display_patterns(_SHOWN)
    for pattern in (plain, spaced):
        pattern = pattern.replace("(?iu)", "(?i)").replace(r"(?![\p{L}\p{M}\p{N}])", r"($|[^\p{L}\p{M}\p{N}])")
        # Twice, because a consuming guard skips a word that shares its separator.
        for _ in range(2):
            column = f"regexp_replace({column}, {q(pattern)}, '\\1{wording.DISPLAY_MASK}\\2', 'g')"
    return column


@query(
    "prj6_mask_display_words",
    f"""SELECT doc_id AS msg_id, shown, shown <> text AS has_masked FROM (SELECT doc_id, text, {_display_sql('text')} AS shown FROM documents)""",
)
def mask_display_words(spark, folder):
    shown = messages.documents(spark, folder).withColumn("shown", t.display_masked(F.col("text"), _SHOWN))
    return shown.select("msg_id", "shown", (F.col("shown") != F.col("text")).alias("has_masked"))


@query(
    "prj7_other_scripts",
    f"""SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, {q('[' + ''.join(f'{chr(92)}p{{{s}}}' for s in pack.OTHER_SCRIPTS) + ']')})) AS n_flagged
        FROM documents GROUP BY lang""",
)
def other_scripts(spark, folder):
    flag = F.col("text").rlike("[" + "".join(f"\\p{{Is{s}}}" for s in pack.OTHER_SCRIPTS) + "]")
    return messages.documents(spark, folder).groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(flag).alias("n_flagged")
    )


def script(text):
    return F.when(text.rlike(r"\p{IsDevanagari}"), "hi").when(text.rlike(r"\p{IsBengali}"), "bn").otherwise("Latn")


@query(
    "prj8_dominant_script",
    rf"""WITH {M} SELECT lang, CASE WHEN regexp_matches(text, '\p{{Devanagari}}') THEN 'hi'
             WHEN regexp_matches(text, '\p{{Bengali}}') THEN 'bn' ELSE 'Latn' END AS script, count(*) AS n FROM m GROUP BY ALL""",
)
def dominant_script(spark, folder):
    m = messages.templated(spark, folder)
    return m.groupBy("lang", script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query(
    "prj9_instruction_like",
    f"WITH {M} SELECT msg_id, {' OR '.join(has_sql('text', p) for p in pack.INSTRUCTION_LIKE)} AS flagged FROM m",
)
def instruction_like(spark, folder):
    return messages.templated(spark, folder).select(
        "msg_id", rules.any_of(F.col("text"), pack.INSTRUCTION_LIKE).alias("flagged")
    )


@query("prj10_asks_reader_to_act", f"WITH {M} SELECT msg_id, {has_sql('text', pack.READER_ASK)} AS asks FROM m")
def asks_reader(spark, folder):
    return messages.templated(spark, folder).select("msg_id", F.col("text").rlike(pack.READER_ASK).alias("asks"))


def purpose_class(has_promotion, explains):
    return (
        F.when(has_promotion & explains, "mixed").when(has_promotion, "promotional")
        .when(explains, "educational").otherwise("unclear")
    )


_PURPOSE_SQL = f"""CASE WHEN promo AND explains THEN 'mixed' WHEN promo THEN 'promotional' WHEN explains THEN 'educational' ELSE 'unclear' END"""


@query(
    "prj11_purpose_class",
    f"""WITH {FINDINGS} SELECT msg_id, {_PURPOSE_SQL} AS purpose_class FROM (
        SELECT msg_id, {has_sql('text', pack.EXPLANATORY)} AS explains,
               msg_id IN (SELECT msg_id FROM f WHERE rule_id IN {pack.PROMOTIONAL_RULES}) AS promo FROM m)""",
)
def purpose(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    promo = (
        rules.findings(m, with_mask=False).where(F.col("rule_id").isin(*pack.PROMOTIONAL_RULES))
        .select("msg_id").distinct().withColumn("promo", F.lit(True))
    )
    # Tested before the join, so that texts are not shuffled.
    explains = m.select("msg_id", F.col("text").rlike(pack.EXPLANATORY).alias("explains"))
    return explains.join(promo, "msg_id", "left").select(
        "msg_id", purpose_class(F.coalesce("promo", F.lit(False)), F.col("explains")).alias("purpose_class")
    )


_CONCEPTS_SQL = "[" + ", ".join(f"CASE WHEN {has_sql('text', p)} THEN {q(c)} END" for c, p in pack.CONCEPTS) + "]"


@query(
    "prj12_concept_tags",
    f"""WITH {M} SELECT concept, count(*) AS n FROM (
        SELECT unnest(CASE WHEN len(tags) = 0 THEN ['risk'] ELSE tags[1:3] END) AS concept
        FROM (SELECT list_filter({_CONCEPTS_SQL}, lambda c: c IS NOT NULL) AS tags FROM m)) GROUP BY concept""",
)
def concept_tags(spark, folder):
    m = messages.templated(spark, folder)
    return m.select(F.explode(rules.concepts(F.col("text"))).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


@query(
    "prj13_localised_copy",
    f"""WITH {M}, copy AS ({dim_sql(templates.COPY_COLUMNS, templates.COPY)})
        SELECT x.lang, x.key, coalesce(own.copy, en.copy) AS copy, count(*) AS n
        FROM (SELECT lang, CASE WHEN expected THEN 'attention' ELSE 'context' END AS key FROM m) x
        LEFT JOIN copy own ON own.key = x.key AND own.lang = string_split(x.lang, '-')[1]
        LEFT JOIN copy en ON en.key = x.key AND en.lang = 'en' GROUP BY ALL""",
)
def localised_copy(spark, folder):
    copy = dim(spark, templates.COPY_COLUMNS, templates.COPY).groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "copy"))).alias("copies")
    )
    m = messages.templated(spark, folder).select(
        "lang", F.when(F.col("expected"), "attention").otherwise("context").alias("key")
    )
    base = F.split_part("lang", F.lit("-"), F.lit(1))
    shown = F.coalesce(F.try_element_at("copies", base), F.try_element_at("copies", F.lit("en")))
    return m.join(copy, "key", "left").groupBy("lang", "key", shown.alias("copy")).agg(F.count("*").alias("n"))


@query(
    "prj14_ordinary_contexts",
    f"WITH {M} SELECT msg_id, "
    + ", ".join(f"{rules.exempt_sql('text', e[0])} AS {e[0].replace('-', '_')}" for e in pack.EXEMPTIONS)
    + " FROM m",
)
def ordinary_contexts(spark, folder):
    return messages.templated(spark, folder).select(
        "msg_id", *[rules.exempt(F.col("text"), e[0]).alias(e[0].replace("-", "_")) for e in pack.EXEMPTIONS]
    )


@query(
    "prj15_allowed_hosts",
    f"""SELECT page_id, host, starts_with(url, 'https://') AND {has_sql('host', library.ALLOWED_HOST)} AS allowed
        FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)""",
)
def allowed_hosts(spark, folder):
    host = F.parse_url("url", F.lit("HOST"))
    return read_table(spark, folder, "pages").select(
        "page_id", host.alias("host"),
        (F.col("url").startswith("https://") & host.rlike(library.ALLOWED_HOST)).alias("allowed"),
    )


def labelled(masked, lang):
    shown = masked
    for placeholder, label in wording.PLACEHOLDER_LABELS.items():
        shown = F.replace(shown, F.lit(placeholder), F.lit(label))
    return F.when(lang == "bn", shown).otherwise(masked)


def _labelled_sql(column: str) -> str:
    for placeholder, label in wording.PLACEHOLDER_LABELS.items():
        column = f"replace({column}, {q(placeholder)}, {q(label)})"
    return column


@query(
    "prj16_placeholder_labels",
    f"""WITH {M} SELECT msg_id, CASE WHEN string_split(lang, '-')[1] = 'bn' THEN {_labelled_sql('masked')} ELSE masked END AS shown
        FROM (SELECT msg_id, lang, {t.masked_sql('text', PHONE_FIRST)} AS masked FROM m)""",
)
def placeholder_labels(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "lang", t.masked(F.col("text")).alias("masked"))
    return m.select("msg_id", labelled(F.col("masked"), F.split_part("lang", F.lit("-"), F.lit(1))).alias("shown"))
