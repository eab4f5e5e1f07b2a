"""Numeric claims for the SQL oracle, written with window functions over match rows."""

from __future__ import annotations

from assayer.core.dims import sql_literal as q
from assayer.core.regex import has_sql
from assayer.functions import numbers as n
from assayer.packs import measures as w


def matches_sql(source: str, column: str, pattern: str) -> str:
    """(msg_id, clause_no, ord, pos, hit) of every match of a pattern."""
    return f"""
SELECT msg_id, clause_no, ord, hit, {column},
       CAST(sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit) AS BIGINT) AS pos
FROM (SELECT msg_id, clause_no, {column}, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) - 1 AS ord
      FROM (SELECT msg_id, clause_no, {column}, regexp_extract_all({column}, {q(pattern)}) AS hits,
                   regexp_split_to_array({column}, {q(pattern)}) AS gaps FROM {source}))
WINDOW w AS (PARTITION BY msg_id, clause_no ORDER BY ord ROWS UNBOUNDED PRECEDING)"""


def ctes(source: str, column: str = "det") -> str:
    """CTEs named nc_*; ``nc_claim`` has (msg_id, clause_no, kind, percent)."""
    num = "CAST(regexp_extract(hit, '^[0-9]+(?:\\.[0-9]+)?') AS DOUBLE)"
    scale = " ".join(f"WHEN {has_sql('unit', p)} THEN {v!r}::DOUBLE" for p, v in n.SCALES)
    return f"""
nc_text AS (SELECT msg_id, clause_no, {n.without_costs_sql(column)} AS t FROM {source}),
nc_q AS ({matches_sql('nc_text', 't', n.QUANTIFIED)}),
nc_r AS ({matches_sql('nc_text', 't', n.RECURRING)}),
nc_time AS (
  SELECT msg_id, clause_no, ord, pos, {num} * {n.unit_days_sql('hit')} AS days, true AS quantified FROM nc_q WHERE {num} > 0
  UNION ALL SELECT msg_id, clause_no, ord + 1000000, pos, {n.unit_days_sql('hit')}, false FROM nc_r),
nc_p AS ({matches_sql('nc_text', 't', n.PERCENT)}),
nc_rate AS (
  SELECT msg_id, clause_no, ord, pos, {num} AS rate FROM nc_p
  WHERE NOT {has_sql('substr(t, greatest(0, pos - 18) + 1, pos + length(hit) + 25 - greatest(0, pos - 18))', n.NOT_A_RETURN)}),
nc_a AS ({matches_sql('nc_text', 't', n.AMOUNT)}),
nc_money AS (
  SELECT *, value0 * CASE {scale} ELSE 1.0::DOUBLE END AS value FROM (
    SELECT msg_id, clause_no, ord, pos,
           CAST(replace(regexp_extract(hit, {q(n.NUMBER)}), ',', '') AS DOUBLE) AS value0,
           regexp_extract(hit, {q(w.UNIT_OF_AMOUNT)}, 1) AS unit,
           CASE WHEN starts_with(hit, '$') THEN 'USD'
                WHEN {has_sql('hit', w.RUPEES)} THEN 'INR'
                ELSE nullif(upper(regexp_extract(hit, {q(w.NAMED)}, 1)), '') END AS currency,
           NOT {has_sql('substr(t, pos + length(hit) + 1, 35)', w.OTHER_COUNT)}
           AND ({has_sql('substr(t, greatest(0, pos - 45) + 1, least(pos, 45))', w.CUE_BEFORE)}
             OR {has_sql('substr(t, pos + length(hit) + 1, 35)', w.CUE_AFTER)}) AS cue
    FROM nc_a) WHERE currency IS NOT NULL OR cue),
nc_m AS ({matches_sql('nc_text', 't', n.MULTIPLIER)}),
nc_multiple AS (
  SELECT msg_id, clause_no, ord, pos, coalesce(TRY_CAST(nullif(regexp_extract(hit, '^[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE),
         CASE WHEN {has_sql('hit', w.THREEFOLD)} THEN 3.0 ELSE 2.0 END) AS multiple FROM nc_m),
nc_rate_near AS (
  SELECT *, row_number() OVER (PARTITION BY msg_id, clause_no, ord ORDER BY abs(tpos - pos), tord) AS rk
  FROM (SELECT r.*, t.pos AS tpos, t.ord AS tord, t.days FROM nc_rate r JOIN nc_time t USING (msg_id, clause_no))),
nc_pick1 AS (
  SELECT msg_id, clause_no, arg_min(pct, ord) AS percent FROM (
    SELECT r.msg_id, r.clause_no, r.ord, {n.annualised_sql('(1 + rate / 100)', 'days')} AS pct
    FROM nc_rate_near r JOIN nc_text USING (msg_id, clause_no) WHERE rk = 1 AND {has_sql('t', n.INVESTMENT)})
  WHERE pct >= {n.THRESHOLD_PERCENT} GROUP BY ALL),
nc_span AS (SELECT msg_id, clause_no, max(days) AS longest, min(days) AS shortest FROM nc_time GROUP BY ALL),
nc_pick2 AS (
  SELECT msg_id, clause_no, pct AS percent FROM (
    SELECT msg_id, clause_no, {n.annualised_sql('(last_value / principal)', 'longest')} AS pct FROM (
      SELECT m.msg_id, m.clause_no, longest, last_value,
             first_value * CASE WHEN {has_sql('t', n.CONTRIBUTION)} THEN greatest(1.0, round(longest / (365.0 / 12))) ELSE 1.0 END AS principal
      FROM (SELECT msg_id, clause_no, arg_min(value, ord) AS first_value, arg_max(value, ord) AS last_value
            FROM nc_money GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT coalesce(currency, '?')) = 1) m
      JOIN nc_span USING (msg_id, clause_no) JOIN nc_text USING (msg_id, clause_no) WHERE {has_sql('t', n.INVESTMENT)})
    WHERE principal > 0)
  WHERE pct >= {n.THRESHOLD_PERCENT}),
nc_multiple_near AS (
  SELECT *, row_number() OVER (PARTITION BY msg_id, clause_no, ord
     ORDER BY CASE WHEN quantified AND tpos >= pos AND tpos - pos < 60 THEN 0 WHEN quantified THEN 1 ELSE 2 END,
              CASE WHEN quantified AND tpos >= pos AND tpos - pos < 60 THEN 0 ELSE abs(tpos - pos) END, tord) AS rk
  FROM (SELECT m.*, t.pos AS tpos, t.ord AS tord, t.days, t.quantified FROM nc_multiple m JOIN nc_time t USING (msg_id, clause_no))),
nc_pick3 AS (
  SELECT msg_id, clause_no, arg_min(pct, ord) AS percent
  FROM (SELECT *, {n.annualised_sql('multiple', 'days')} AS pct FROM nc_multiple_near WHERE rk = 1)
  WHERE pct >= {n.THRESHOLD_PERCENT} GROUP BY ALL
  UNION ALL
  SELECT DISTINCT m.msg_id, m.clause_no, CAST(NULL AS DOUBLE) FROM nc_multiple m JOIN nc_text x USING (msg_id, clause_no)
  WHERE multiple >= 2 AND ({has_sql('t', n.INVESTMENT)} OR {has_sql('t', w.MADE)})
    AND NOT EXISTS (SELECT 1 FROM nc_time t WHERE t.msg_id = m.msg_id AND t.clause_no = m.clause_no)),
nc_pick4 AS (
  SELECT x.msg_id, x.clause_no FROM nc_text x JOIN nc_span s USING (msg_id, clause_no)
  WHERE shortest <= 31 AND EXISTS (SELECT 1 FROM nc_money m WHERE m.msg_id = x.msg_id AND m.clause_no = x.clause_no)
    AND {has_sql('t', n.INVESTMENT)} AND {has_sql('t', n.PAYOUT)} AND NOT {has_sql('t', n.WAGES)}),
nc_claim AS (
  SELECT msg_id, clause_no, arg_min(kind, priority) AS kind, arg_min(coalesce(percent, -1), priority) AS percent0 FROM (
    SELECT msg_id, clause_no, 1 AS priority, 'percentage' AS kind, percent FROM nc_pick1
    UNION ALL SELECT msg_id, clause_no, 2, 'amount-ratio', percent FROM nc_pick2
    UNION ALL SELECT msg_id, clause_no, 3, 'multiplier', percent FROM nc_pick3
    UNION ALL SELECT msg_id, clause_no, 4, 'periodic-payout', NULL FROM nc_pick4) GROUP BY ALL)"""
