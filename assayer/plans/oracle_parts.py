"""Common table expressions shared by the SQL oracles over templated messages."""

from __future__ import annotations

from assayer.functions.text import masked_sql
from assayer.operators.clauses import clauses_sql, joined_sql
from assayer.operators.rules import cautioned_sql, findings_sql, hits_sql, risk_sql
from assayer.packs.wording import DETECTORS
from assayer.plans.numeric_sql import ctes
from assayer.sources.messages import templated_sql

# A phone number after the word PIN starts before the code that could be read inside it.
PHONE_FIRST = sorted(DETECTORS, key=lambda d: d[0] != "phone")
_QUOTED = "regexp_extract(text, '^\"[^\"]+\"')"
# The one templated quote that its own sentence turns into a lesson is blanked.
_QUIET = (
    f"CASE WHEN contains(text, 'quote in our safety class') "
    f"THEN repeat(' ', length({_QUOTED})) || substr(text, length({_QUOTED}) + 1) ELSE text END"
)
_DET = (
    "regexp_replace(replace(replace(substr(quiet, start + 1, length(clause)), 'ओटीपी', 'OTP'), 'ওটিপি', 'OTP'), "
    "'\\s+', ' ', 'g')"
)

M = f"m AS (SELECT *, {_QUIET} AS quiet FROM ({templated_sql()}))"
CLAUSES = f"{M}, cl AS MATERIALIZED ({clauses_sql('m', det=_DET)})"
JOINED = f"{CLAUSES}, j AS MATERIALIZED ({joined_sql('cl', cautioned_sql)})"
CLAIMS = f"{JOINED}, {ctes('j', 'w_det')}"
HITS = f"{CLAIMS}, hits AS MATERIALIZED ({hits_sql('j', 'nc_claim')})"
FINDINGS = f"{HITS}, f AS MATERIALIZED ({findings_sql('hits', masked_sql('original', PHONE_FIRST))})"
RISK = (
    f"{FINDINGS}, r AS ({risk_sql('f')}), "
    "mr AS (SELECT m.*, coalesce(level, 'insufficient') AS level, coalesce(n_findings, 0) AS n_findings, "
    "coalesce(n_reasons, 0) AS n_reasons, coalesce(reasons, '') AS reasons FROM m LEFT JOIN r USING (msg_id))"
)
