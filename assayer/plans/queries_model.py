"""The wording classifier."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, zip_longest
from unicodedata import normalize

import pyarrow as pa
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.core.dims import dim_sql
from assayer.core.dims import sql_literal as q
from assayer.core.regex import has_sql
from assayer.core.session import read_table, settle
from assayer.functions import hashing
from assayer.functions import text as t
from assayer.functions.hashing import BUCKETS, MASK, OFFSET, PRIME, place_features
from assayer.operators import clauses as c
from assayer.operators import model, rules
from assayer.packs import rules as pack
from assayer.packs import templates, wording
from assayer.plans.catalog import query
from assayer.plans.oracle_parts import FINDINGS, M
from assayer.plans.queries_aggregates import summarise_held_out
from assayer.sources import messages

_TOKENS = r"regexp_extract_all(regexp_replace(lower(nfc_normalize(text)), '\p{Nd}', '0', 'g'), '[\p{L}\p{M}\p{N}]+|[₹%$@]')"


@query(
    "mdl1_model_tokens",
    f"SELECT doc_id AS msg_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL",
)
def model_tokens(spark, folder):
    docs = messages.documents(spark, folder)
    tokens = docs.select("msg_id", F.explode(t.model_tokens(t.nfc(F.col("text")))).alias("token"))
    return tokens.groupBy("msg_id", "token").agg(F.count("*").alias("n"))


def _sound_sql(column: str) -> str:
    for old, new in wording.SOUND_FOLDS:
        column = f"replace({column}, {q(old)}, {q(new)})"
    # RE2 has no back-references, so repeats are dropped letter by letter.
    letters = f"regexp_split_to_array({column}, '')"
    bare = (
        f"array_to_string(list_filter({letters}, lambda x, i: i = 1 OR x <> {letters}[i - 1]), '')"
    )
    return f"regexp_replace({bare}, '^(.{{3,}})a$', '\\1')"


@query(
    "mdl2_sound_keys",
    f"""SELECT token, {_sound_sql('token')} AS key FROM (SELECT DISTINCT unnest({_TOKENS}) AS token FROM documents)""",
)
def sound_keys(spark, folder):
    """Keys of the distinct tokens only; a join brings them back where they are needed."""
    docs = messages.documents(spark, folder)
    vocabulary = docs.select(F.explode(t.model_tokens(t.nfc(F.col("text")))).alias("token")).distinct()
    return vocabulary.select("token", t.sound_key(F.col("token")).alias("key"))


@query("mdl2_sound_keys_templated")
def sound_keys_templated(spark, folder):
    m = messages.templated(spark, folder)
    vocabulary = m.select("lang", F.explode(t.model_tokens(t.nfc(F.col("text")))).alias("token")).distinct()
    return vocabulary.select("lang", "token", t.sound_key(F.col("token")).alias("key"))


# The oracle hashes the features of distinct tokens and token pairs once. Sound keys of Latin tokens come from SQL, those
# of the other scripts' words, which only the message forms have, from the spelling rules.
_SPELLED = sorted({
    (token, hashing.sound(token))
    for row in templates.rows() for token in regex.findall(r"[\p{L}\p{M}\p{N}]+", normalize("NFC", row[-1]).lower()) if not token.isascii()
})
_KEYS = f"""sk AS MATERIALIZED (SELECT token, coalesce(spelled.key, {_sound_sql('token')}) AS key
        FROM (SELECT DISTINCT token FROM tk) LEFT JOIN ({dim_sql('token, key', _SPELLED)}) spelled USING (token))"""


def _grams_sql(kind: str, word: str, low: int, high: int, source: str) -> str:
    return (
        f"SELECT token, '{kind}|' || substr(' ' || {word} || ' ', s, n) AS feature FROM (SELECT token, {word}, n, unnest(range(1, length({word}) + 4 - n)) AS s "
        f"FROM (SELECT token, {word}, unnest(range({low}, least({high}, length({word}) + 2) + 1)) AS n FROM {source}))"
    )


_FEATURES = f"""{M},
tk AS (SELECT msg_id, token, place, lead(token) OVER (PARTITION BY msg_id ORDER BY place) AS after
       FROM (SELECT msg_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS place FROM (SELECT msg_id, {_TOKENS} AS ts FROM m))),
{_KEYS},
one AS (SELECT token, 'w|' || token AS feature FROM sk UNION ALL SELECT token, 'k|' || key FROM sk
        UNION ALL {_grams_sql('c', 'token', 2, 5, '(SELECT DISTINCT token FROM sk)')} UNION ALL {_grams_sql('s', 'key', 3, 4, 'sk')}),
onehash AS MATERIALIZED (SELECT token, CAST({hashing.fnv1a_sql('feature')} % {hashing.BUCKETS} AS INTEGER) AS idx FROM one),
two AS (SELECT DISTINCT token, after FROM tk WHERE after IS NOT NULL),
pair AS (SELECT token, after, 'b|' || token || '|' || after AS feature FROM two
         UNION ALL SELECT t.token, t.after, 'kb|' || a.key || '|' || b.key FROM two t JOIN sk a ON a.token = t.token JOIN sk b ON b.token = t.after),
twohash AS MATERIALIZED (SELECT token, after, CAST({hashing.fnv1a_sql('feature')} % {hashing.BUCKETS} AS INTEGER) AS idx FROM pair),
cnt AS (SELECT msg_id, idx, count(*) AS n FROM (
          SELECT msg_id, idx FROM tk JOIN onehash USING (token)
          UNION ALL SELECT msg_id, idx FROM tk JOIN twohash USING (token, after)) GROUP BY ALL),
feat AS (SELECT msg_id, idx, (1 + ln(n)) / sqrt(sum((1 + ln(n)) * (1 + ln(n))) OVER (PARTITION BY msg_id)) AS value FROM cnt),
sc AS (SELECT msg_id, 1 / (1 + exp(-({model.FROZEN_BIAS} + sum({model.FROZEN_WEIGHT_SQL} * value)))) AS score FROM feat GROUP BY msg_id)"""


def _summary(feats):
    return feats.groupBy("msg_id").agg(
        F.count("*").alias("n_buckets"), F.sum("idx").alias("idx_sum"), F.round(F.max("value"), 6).alias("top_value"),
        F.round(F.sum(F.col("value") * F.col("value")), 6).alias("squares"),
    )


_FEATURE_SUMMARY = f"""WITH {_FEATURES} SELECT msg_id, count(*) AS n_buckets, CAST(sum(idx) AS BIGINT) AS idx_sum, round(max(value), 6) AS top_value,
        round(sum(value * value), 6) AS squares FROM feat GROUP BY msg_id"""


@query("mdl3_features", _FEATURE_SUMMARY)
def features(spark, folder):
    return _summary(model.features(messages.templated(spark, folder).select("msg_id", "text")))


@query("mdl3_features_all_kinds", _FEATURE_SUMMARY)
def features_all_kinds(spark, folder):
    return _summary(model.features(messages.templated(spark, folder).select("msg_id", "text"), hashing.ALL_KINDS))


@query(
    "mdl3_term_weights",
    f"""SELECT msg_id, token, round((1 + ln(n)) / sqrt(sum((1 + ln(n)) * (1 + ln(n))) OVER (PARTITION BY msg_id)), 6) AS value
        FROM (SELECT doc_id AS msg_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL)""",
)
def term_weights(spark, folder):
    """Sublinear, unit-length token weights of whole documents."""
    counts = model_tokens(spark, folder).select("msg_id", "token", (1 + F.log("n")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("msg_id")))
    return counts.select("msg_id", "token", F.round(F.col("raw") / norm, 6).alias("value"))


def training_set(spark, folder):
    """(features, labels) of all labelled documents; a document's features stay in its row.

    Masked texts are written first: masking and features each need Python workers, which would else be held together.
    """
    labels = read_table(spark, folder, "labels").select(
        F.col("doc_id").alias("msg_id"), (F.col("quality") == 0).cast("double").alias("label")
    )
    docs = messages.documents(spark, folder).join(labels, "msg_id")
    masked = docs.select("msg_id", "source", "label", t.masked(F.col("text")).alias("text"))
    return model.listed_features(settle(masked, "masked")), docs.select("msg_id", "source", "label")


@query("mdl4_train")
def train(spark, folder):
    """Train on all labelled documents; returns the largest weights, with the bias at -1."""
    listed, _ = training_set(spark, folder)
    fitted = model.fit(model.settled_vectors(listed, BUCKETS))
    weights, bias = model.pruned(spark, fitted)
    return weights.unionByName(spark.range(1).select(F.lit(-1).alias("idx"), F.lit(bias).alias("w")))


@query("mdl4_leave_one_source_out")
def leave_one_source_out(spark, folder):
    return summarise_held_out(model.leave_one_source_out(*training_set(spark, folder)), model.THRESHOLD)


@query(
    "mdl5_prune_weights",
    f"""WITH {_FEATURES} SELECT idx, round(w * 10000) / 10000 AS w FROM (
        SELECT idx, {model.FROZEN_WEIGHT_SQL} AS w FROM (SELECT DISTINCT idx FROM feat) ORDER BY abs(w) DESC, idx LIMIT {model.KEEP})""",
)
def prune_weights(spark, folder):
    """The largest weights among the buckets that the messages use, ties by bucket."""
    used = model.features(messages.templated(spark, folder).select("msg_id", "text")).select("idx").distinct()
    return model.prune(used.join(model.frozen_weights(spark), "idx"))


def frozen_scores(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text")
    return model.scored(m, model.frozen_weights(spark), model.FROZEN_BIAS)


@query("mdl7_batch_score", f"WITH {_FEATURES} SELECT msg_id, round(score, 6) AS score FROM sc")
def batch_score(spark, folder):
    return frozen_scores(spark, folder).select("msg_id", F.round("score", 6).alias("score"))


_CUT = model.THRESHOLD


@query(
    "mdl8_model_findings",
    f"""WITH {FINDINGS}, {_FEATURES[len(M) + 1:]}
        SELECT msg_id, 'pattern-match' AS rule_id, 'attention' AS severity FROM sc JOIN m USING (msg_id)
        WHERE score >= {_CUT} AND {has_sql('text', pack.READER_ASK)}
          AND NOT EXISTS (SELECT 1 FROM f WHERE f.msg_id = m.msg_id AND f.severity = 'attention')""",
)
def model_findings(spark, folder):
    """Model findings only for messages that ask for an act and that no rule warned about.

    Rules and the ask run first: scoring never sees the messages they settle.
    """
    m = messages.templated(spark, folder).select("msg_id", "text")
    warned = rules.findings(m, with_mask=False).where("severity = 'attention'").select("msg_id").distinct()
    left = m.where(F.col("text").rlike(pack.READER_ASK)).join(warned, "msg_id", "left_anti")
    scores = model.scored(left, model.frozen_weights(spark), model.FROZEN_BIAS)
    return scores.where(F.col("score") >= _CUT).select(
        "msg_id", F.lit("pattern-match").alias("rule_id"), F.lit("attention").alias("severity")
    )


_BIAS = model.FROZEN_BIAS


@F.arrow_udf(T.DoubleType())
def _score_alone(text: pa.Array) -> pa.Array:
    """An independent scorer: one message at a time, from the definition. A batch hashes a feature once, a message counts each once."""
    known: dict[str, int] = {}

    def bucket(feature: str) -> int:
        if feature not in known:
            code = OFFSET
            for byte in feature.encode():
                code = ((code ^ byte) * PRIME) & MASK
            known[feature] = code % BUCKETS
        return known[feature]

    places: dict[tuple[str, str | None], list[int]] = {}

    def place(token: str, following: str | None) -> list[int]:
        key_after = None if following is None else hashing.sound(following)
        found = place_features(token, hashing.sound(token), following, key_after, hashing.ALL_KINDS.split())
        places[token, following] = [bucket(feature) for feature in found]
        return places[token, following]

    damped: dict[int, float] = {}
    out = []
    for message in text.to_pylist():
        if len(known) > 500_000:  # what is remembered stays bounded
            known.clear()
            places.clear()
        tokens = regex.findall(r"[\p{L}\p{M}\p{N}]+|[₹%$@]", regex.sub(r"\p{Nd}", "0", message.lower()))
        pairs = zip_longest(tokens, tokens[1:])
        counts = Counter(chain.from_iterable(places.get(pair) or place(*pair) for pair in pairs))
        # Weights are whole numbers over 500: those of buckets that occur as often add up exactly.
        sums: dict[int, int] = {}
        for index, n in counts.items():
            sums[n] = sums.get(n, 0) + index * 7919 % 2001 - 1000
        sizes = Counter(counts.values())
        for n in sizes:
            if n not in damped:
                damped[n] = 1 + math.log(n)
        norm = math.sqrt(sum(m * damped[n] ** 2 for n, m in sizes.items())) or 1.0
        total = sum(damped[n] * sums[n] for n in sizes) / 500 / norm
        out.append(1 / (1 + math.exp(-(_BIAS + total))))
    return pa.array(out, pa.float64())


@query("mdl9_score_parity", f"WITH {M} SELECT count(*) AS n_checked, 0::BIGINT AS n_apart FROM m")
def score_parity(spark, folder):
    """Distributed scores against an independent scorer, within 1e-9, over every message."""
    m = messages.templated(spark, folder).select("msg_id", "text")
    alone = m.select("msg_id", _score_alone(t.nfc(F.col("text"))).alias("recorded"))
    both = frozen_scores(spark, folder).join(alone, "msg_id")
    return both.agg(
        F.count("*").alias("n_checked"), F.count_if(F.abs(F.col("score") - F.col("recorded")) > 1e-9).alias("n_apart")
    )


@query("win6_strongest_by_model")
def strongest_by_model(spark, folder):
    """The sentence most like the training messages, per message asking for an act.

    A message without a sentence of six characters is judged as a whole.
    """
    m = messages.templated(spark, folder).where(F.col("text").rlike(pack.READER_ASK)).select("msg_id", "text")
    sentences = F.filter(
        F.transform(c.clause_array(F.col("text"), False), lambda x, i: F.struct(i.alias("no"), F.trim(x["clause"]).alias("text"))),
        lambda s: F.length(s["text"]) >= 6,
    )
    whole = F.array(F.struct(F.lit(0).alias("no"), F.trim("text").alias("text")))
    parts = m.select(F.col("msg_id").alias("owner"), sentences.alias("s"), whole.alias("whole")).select(
        "owner", F.inline(F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("whole")))
    )
    keyed = parts.withColumn("msg_id", F.struct("owner", "no"))
    scores = model.scored(keyed.select("msg_id", "text"), model.frozen_weights(spark), model.FROZEN_BIAS)
    best = scores.groupBy(F.col("msg_id.owner").alias("owner")).agg(
        F.min(F.struct((-F.col("score")).alias("minus"), F.col("msg_id.no").alias("no"))).alias("b")
    ).select("owner", "b.no", (-F.col("b.minus")).alias("score"))
    return parts.join(best, ["owner", "no"]).select(
        F.col("owner").alias("msg_id"), F.col("no").alias("clause_no"), F.round("score", 6).alias("score"),
        F.substring("text", 1, 300).alias("excerpt"),
    )
