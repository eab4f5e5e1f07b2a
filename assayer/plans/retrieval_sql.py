"""Retrieval for the SQL oracle."""

from __future__ import annotations

from assayer.core.dims import dim_sql
from assayer.core.dims import sql_literal as q
from assayer.operators.retrieval import B, K1, MIN_SCORE
from assayer.packs import library, wording

STOP = "[" + ", ".join(q(w) for w in wording.STOP_WORDS) + "]"


def tokens_sql(source: str, key: str, text: str = "text") -> str:
    """(key, token, tf) of a relation."""
    clean = (
        f"lower(replace(replace(regexp_replace({text}, '(?i)https?://\\S+', ' ', 'g'), 'ओटीपी', 'OTP'), 'ওটিপি', 'OTP'))"
    )
    return f"""
SELECT {key}, token, count(*) AS tf
FROM (SELECT {key}, unnest(regexp_extract_all({clean}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS token FROM {source})
WHERE length(token) > 1 AND NOT regexp_full_match(token, '\\p{{N}}+') AND NOT list_contains({STOP}, token)
GROUP BY ALL"""


def bm25_ctes(queries: str, corpus: str, name: str = "bm") -> str:
    """CTEs for queries (q_id, text) and a corpus (doc_id, text); scores end up in {name}_score."""
    return f"""
{name}_q AS (SELECT DISTINCT q_id, token FROM ({tokens_sql(queries, 'q_id')})),
{name}_p AS MATERIALIZED ({tokens_sql(corpus, 'doc_id')}),
{name}_len AS (SELECT doc_id, sum(tf) AS n_tokens FROM {name}_p GROUP BY doc_id),
{name}_df AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY token),
{name}_n AS (SELECT (SELECT count(*) FROM {corpus}) AS n, (SELECT sum(tf) FROM {name}_p) / (SELECT count(*) FROM {corpus}) AS average),
{name}_score AS (SELECT * FROM (
  SELECT q_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({K1} + 1)
           / (tf + {K1} * (1 - {B} + {B} * n_tokens / average))), 4) AS score
  FROM {name}_q JOIN {name}_p USING (token) JOIN {name}_df USING (token) JOIN {name}_len USING (doc_id) CROSS JOIN {name}_n
  GROUP BY ALL) WHERE score >= {MIN_SCORE})"""


CARDS = f"cards AS ({dim_sql(library.CARD_COLUMNS, library.CARDS)})"
SOURCES = f"sources AS ({dim_sql(library.SOURCE_COLUMNS, library.SOURCES)})"
PAIRS = f"pairs AS ({dim_sql(library.PAIR_COLUMNS, library.CONTRAST_PAIRS)})"
_CORPUS = "(SELECT card_id AS doc_id, concat_ws(' ', title, passage, aliases) AS text FROM cards)"
# All cards together stay far below the budget, so the five best are the selection.
RETRIEVED = (
    f"{CARDS}, {SOURCES}, {bm25_ctes('(SELECT msg_id AS q_id, text FROM m)', _CORPUS, 'cb')}, "
    "retrieved AS MATERIALIZED (SELECT q_id AS msg_id, doc_id AS card_id, score, CAST(rk AS INTEGER) AS rank, source_id, category_ids FROM ("
    "SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rk FROM cb_score) "
    "JOIN cards ON card_id = doc_id WHERE rk <= 5)"
)
