"""Rule matching, cautions, first-match picking and risk tiers.

Rules are a small fixed pack, so each wording test is one literal pattern that
compiles once per task, and no join is needed. A message's clauses, hits, best hits
and tier are arrays in its own row: between the scan and the tier nothing is
shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.core.dims import dim, dim_sql, sql_literal
from assayer.core.regex import bind, folded, has_sql, once
from assayer.functions.literals import Guard, holds, may
from assayer.functions.numbers import WORTH, numeric_claim
from assayer.functions.text import detection_text, masked
from assayer.operators.clauses import clause_rows, widened
from assayer.packs import rules as pack

EXCERPT_LIMIT = 400


def cautions_for(rule_id: str) -> list[tuple]:
    return [c for c in pack.CAUTIONS if c[0] in ("*", rule_id)]


def cautioned(column: Column, rule_id: str = "*") -> Column:
    """A caution wording is present in lower-case text and no switch back to an offer follows it."""
    test = F.lit(False)
    for _, _, _, pattern, unless in cautions_for(rule_id):
        test = test | (column.rlike(folded(pattern)) & ~column.rlike(folded(unless)))
    return test


def cautioned_sql(column: str, rule_id: str = "*") -> str:
    return "(" + " OR ".join(
        f"({has_sql(column, pattern)} AND NOT {has_sql(column, unless)})"
        for _, _, _, pattern, unless in cautions_for(rule_id)
    ) + ")"


def exempt(column: Column, name: str) -> Column:
    _, positive, override = next(e for e in pack.EXEMPTIONS if e[0] == name)
    return column.rlike(positive) & ~column.rlike(override)


def exempt_sql(column: str, name: str) -> str:
    _, positive, override = next(e for e in pack.EXEMPTIONS if e[0] == name)
    return f"({has_sql(column, positive)} AND NOT {has_sql(column, override)})"


def ordinary_deadline(det: Column, prev: Column, nxt: Column) -> Column:
    """A deadline on a bill or a shop offer, alone or together with a neighbour."""
    near = F.greatest(F.length(det), F.length(prev), F.length(nxt)) <= pack.NEIGHBOUR_LIMIT
    return (
        exempt(det, "bill-deadline") | exempt(det, "retail-promotion")
        | (near & (exempt(F.concat_ws(" ", prev, det), "retail-promotion")
                   | exempt(F.concat_ws(" ", det, nxt), "retail-promotion")))
    )


def ordinary_deadline_sql(det: str, prev: str, nxt: str) -> str:
    retail = "retail-promotion"
    return (
        f"({exempt_sql(det, 'bill-deadline')} OR {exempt_sql(det, retail)} OR "
        f"(greatest(length({det}), length({prev}), length({nxt})) <= {pack.NEIGHBOUR_LIMIT} AND "
        f"({exempt_sql(f'({prev} || chr(32) || {det})', retail)} OR {exempt_sql(f'({det} || chr(32) || {nxt})', retail)})))"
    )


_ENDS = list(dict.fromkeys(unless for *_, unless in pack.CAUTIONS))

# One bit per wording test of lower-case text, and one for what a numeric claim needs.
_GUARD = Guard({
    **{f"a {name}": folded(pattern) for name, pattern in pack.ATOMS.items()},
    **{f"c {number}": folded(pattern) for _, number, _, pattern, _ in pack.CAUTIONS},
    **{f"u {number}": folded(pattern) for number, pattern in enumerate(_ENDS)},
    "claim": WORTH,
})


def _atoms(mask: Column, low: Column, names: tuple[str, ...]) -> Column:
    """All of these atoms are in lower-case text, by its bits; a pattern only runs where they leave it open."""
    if not names:
        return F.lit(True)
    test = F.lit(True)
    for name in names:
        test = test & low.rlike(folded(pack.ATOMS[name]))
    return holds(mask, _GUARD.bits(*[f"a {n}" for n in names]), test)


def _guarded_caution(mask: Column, low: Column, rule_id: str = "*") -> Column:
    """``cautioned`` by the text's bits; where none of a caution is set, no other test is made."""
    test, bits = F.lit(False), _GUARD.bits(*[f"c {number}" for _, number, *_ in cautions_for(rule_id)])
    for _, number, _, pattern, unless in cautions_for(rule_id):
        doubt = holds(mask, _GUARD.bits(f"c {number}"), low.rlike(folded(pattern)))
        test = test | (doubt & ~holds(mask, _GUARD.bits(f"u {_ENDS.index(unless)}"), low.rlike(folded(unless))))
    return (mask.bitwiseAND(F.lit(bits).cast("long")) != 0) & test


def _cue(rule: pack.Rule, mask: Column, low: Column) -> Column:
    if rule.rule_id == "outsized":
        return may(mask, _GUARD.bits("claim")) & numeric_claim(low)["kind"].isNotNull()
    test = _atoms(mask, low, rule.cue)
    for atom in rule.cue_not:
        test = test & ~_atoms(mask, low, (atom,))
    return test


@once
def _gates() -> Column:
    """Context gates of the whole message, each only where the cue of its rule may occur."""
    return F.struct(*[
        F.when(
            F.exists("_win", lambda w: may(w["mask"], _GUARD.bits(*[f"a {n}" for n in rule.cue]))),
            F.lower(detection_text(F.col("text"))).rlike(folded(pack.CONTEXT_GATES[rule.rule_id])),
        ).otherwise(False).alias(rule.rule_id)
        for rule in pack.RULES if rule.rule_id in pack.CONTEXT_GATES
    ])


@once
def _near() -> Column:
    """Clauses with their bits and both neighbours, each with its own."""
    def side(i: Column) -> Column:
        clause = F.get("_cl", i)
        return F.struct(
            clause["start"].alias("start"), clause["end"].alias("end"), clause["det"].alias("det"), F.get("_bits", i).alias("mask")
        )

    return F.transform("_cl", lambda c, i: F.struct(side(i).alias("own"), side(i - 1).alias("prev"), side(i + 1).alias("next")))


@once
def _windows() -> Column:
    def test(part: Column, names: tuple[str, ...]) -> Column:
        return _atoms(part["mask"], F.lower(part["det"]), names)

    return F.transform("_near", lambda c: widened(c, test, lambda part: _guarded_caution(part["mask"], F.lower(part["det"]))))


@once
def _row_hits() -> Column:
    def of_clause(gates: Column):
        def hits(window: Column, clause_no: Column) -> Column:
            return bind(F.lower(window["w_det"]), lambda low: F.array_compact(F.array(*[
                F.when(_cue(rule, window["mask"], low), hit(order, rule, window, clause_no, low)) for order, rule in enumerate(pack.RULES)
            ])))

        def hit(order: int, rule: pack.Rule, window: Column, clause_no: Column, low: Column) -> Column:
            mask = window["mask"]
            quiet = _guarded_caution(mask, low, rule.rule_id)
            near = [F.coalesce(window[n], F.lit("")) for n in ("prev_det", "next_det")]
            return bind(quiet, lambda quiet: F.struct(
                F.lit(order).alias("rule_no"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"),
                F.lit(rule.family).alias("family"), F.lit(rule.is_action).alias("is_action"), F.lit(rule.is_scoped).alias("is_scoped"),
                clause_no.alias("clause_no"), window["w_start"].alias("w_start"), window["w_end"].alias("w_end"),
                (gates[rule.rule_id] if rule.rule_id in pack.CONTEXT_GATES else F.lit(True)).alias("in_context"),
                quiet.alias("cautioned"), (_atoms(mask, low, rule.ask) & ~quiet).alias("soliciting"),
                (ordinary_deadline(window["w_det"], *near) if rule.rule_id == "urgency" else F.lit(False)).alias("ordinary"),
            ))

        return hits

    return bind(_gates(), lambda gates: F.flatten(F.transform("_win", of_clause(gates))))


def screened_clauses(messages: DataFrame) -> DataFrame:
    """Messages with ``_hits``: every rule whose cue a clause, joined with what it depends on, carries.

    The whole test stays in the message's row: clauses are an array, and one pass over a
    batch of them settles all wording tests.
    """
    rows = clause_rows(messages, mask_quotes=True)
    said = F.transform("_cl", lambda c: F.lower(c["det"]))
    near = rows.withColumn("_bits", _GUARD.exact(said)).withColumn("_near", _near())
    return near.withColumn("_win", _windows()).withColumn("_hits", _row_hits()).drop("_cl", "_bits", "_near", "_win")


def _quoted(hit: Column) -> Column:
    return F.substring(F.col("text"), hit["w_start"] + 1, hit["w_end"] - hit["w_start"])


def rule_hits(screened: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Theta join of clauses and rules: one row per clause and rule whose cue matches."""
    # An outer explode: a plain one would first filter on the hits, and so find them twice.
    each = screened.select("msg_id", *(keep or []), "text", F.explode_outer("_hits").alias("h")).where("h IS NOT NULL")
    return each.select("msg_id", *(keep or []), "h.*", _quoted(F.col("h")).alias("original"))


@once
def _picked() -> Column:
    """The best hit of every rule, in the order of the rules.

    Non-ordinary deadlines come first for ``urgency`` and live requests first for
    scoped families; then clause order.
    """
    def worse(h: Column) -> Column:
        return (
            F.when(h["rule_id"] == "urgency", h["ordinary"].cast("int"))
            .when(h["is_scoped"], (~h["soliciting"]).cast("int")).otherwise(0)
        )

    def pick(hits: Column) -> Column:
        ranked = F.transform(hits, lambda h: F.struct(
            h["rule_no"], worse(h).alias("worse"), h["clause_no"], h["w_start"], h["w_end"], h["soliciting"], h["rule_id"],
            h["severity"], h["family"], h["is_action"], h["is_scoped"],
        ))
        # Sorted, the best hit of a rule is the one after a hit of another rule.
        return bind(F.array_sort(ranked), lambda all_: F.filter(all_, lambda h, i: (i == 0) | (F.get(all_, i - 1)["rule_no"] != h["rule_no"])))

    def finding(h: Column) -> Column:
        return F.struct(
            h["rule_no"], h["rule_id"], h["family"], h["is_action"], h["is_scoped"],
            F.when(h["worse"] == 1, "context").otherwise(h["severity"]).alias("severity"), F.lit("local").alias("origin"),
            h["clause_no"], h["w_start"], h["w_end"], h["soliciting"], _quoted(h).alias("original"),
        )

    return F.transform(pick(F.filter("_hits", lambda h: h["in_context"] & ~h["cautioned"])), finding)


def judged(messages: DataFrame, hits: bool = False) -> DataFrame:
    """Messages with ``found``: one finding per rule, from its best clause; with ``_hits`` too if asked. Nothing is shuffled."""
    rows = screened_clauses(messages).withColumn("found", _picked())
    return rows if hits else rows.drop("_hits")


def findings(messages: DataFrame, keep: list[str] | None = None, with_mask: bool = True) -> DataFrame:
    """One row per message and rule, from the best clause."""
    fields = ["rule_no", "rule_id", "family", "is_action", "is_scoped", "severity", "origin", "clause_no", "w_start", "w_end", "soliciting"]
    each = judged(messages).select("msg_id", *(keep or []), F.explode_outer("found").alias("f")).where("f IS NOT NULL")
    each = each.select("msg_id", *(keep or []), "f.*")
    excerpt = masked(F.col("original")) if with_mask else F.col("original")
    return each.select("msg_id", *(keep or []), *fields, F.substring(excerpt, 1, EXCERPT_LIMIT).alias("excerpt"))


def _names(items: Column, field: str) -> Column:
    return F.array_distinct(F.transform(items, lambda f: f[field]))


def _level(reasons: Column, families: Column, actions: Column) -> Column:
    """Strong needs two warning families and a local action supported by another
    family; a fee demand with a return promise alone never is."""
    supported = F.exists(
        actions, lambda a: F.exists(families, lambda f: (f != a) & ~((a == "fee-demand") & (f == "return-promise")))
    )
    return (
        F.when((F.size(families) >= 2) & supported, "strong")
        .when(F.size(reasons) > 0, "potential").otherwise("insufficient")
    )


def tiers(messages: DataFrame) -> DataFrame:
    """Every message with n_findings, reason_ids, families and level, all in its own row."""
    rows = judged(messages)
    attention = rows.withColumn("_warn", F.filter("found", lambda f: f["severity"] == "attention"))
    live = F.filter("_warn", lambda f: f["soliciting"])
    named = attention.withColumns({
        "n_findings": F.size("found").cast("long"), "reason_ids": F.array_sort(_names(F.col("_warn"), "rule_id")),
        "families": _names(live, "family"), "_actions": _names(F.filter(live, lambda f: f["is_action"]), "family"),
    })
    return named.withColumn("level", _level(F.col("reason_ids"), F.col("families"), F.col("_actions"))).drop("_warn", "_actions", "found")


def risk(found: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Tier per message from findings that were merged or changed, of messages that have some.

    A finding of the second opinion only supports a tier where ``cited`` is true, and
    never is the local action.
    """
    attention = F.col("severity") == "attention"
    cited = F.coalesce("cited", F.lit(False)) if "cited" in found.columns else F.lit(False)
    counted = attention & F.col("soliciting") & (F.col("rule_id") != "pattern-match") & ((F.col("origin") != "ai") | cited)
    action = counted & F.col("is_action") & (F.col("origin") != "ai")
    per = found.groupBy("msg_id", *(keep or [])).agg(
        F.count("*").alias("n_findings"),
        F.array_sort(F.collect_set(F.when(attention, F.col("rule_id")))).alias("reason_ids"),
        F.collect_set(F.when(counted, F.col("family"))).alias("families"),
        F.collect_set(F.when(action, F.col("family"))).alias("actions"),
    )
    return per.withColumn("level", _level(F.col("reason_ids"), F.col("families"), F.col("actions")))


def with_tier(messages: DataFrame, tiers: DataFrame) -> DataFrame:
    """Every message with its tier; messages without findings are insufficient."""
    return messages.join(
        tiers.select("msg_id", "n_findings", "reason_ids", "families", "level"), "msg_id", "left"
    ).withColumns(
        {"level": F.coalesce("level", F.lit("insufficient")), "n_findings": F.coalesce("n_findings", F.lit(0))}
    )


# One bit per concept; their patterns fold case, as they are tested on the text as it is.
_CONCEPTS = Guard(dict(pack.CONCEPTS), fold=True)


def all_concepts(text: Column) -> Column:
    """Matching concepts in their fixed order; a pattern only runs where the text's bits leave it open."""
    bits = F.get(_CONCEPTS.exact(F.array(text)), 0)
    return F.array_compact(F.array(*[F.when(holds(bits, _CONCEPTS.bits(c), text.rlike(p)), c) for c, p in pack.CONCEPTS]))


def concepts(text: Column) -> Column:
    """First three matching concepts in their fixed order, or the default."""
    found = all_concepts(text)
    return F.when(F.size(found) > 0, F.slice(found, 1, pack.CONCEPT_LIMIT)).otherwise(F.array(F.lit(pack.DEFAULT_CONCEPT)))


def any_of(column: Column, patterns: list[str]) -> Column:
    test = F.lit(False)
    for pattern in patterns:
        test = test | column.rlike(pattern)
    return test


# --- the same rules for the SQL oracle -------------------------------------------


def hits_sql(clauses: str, claims: str) -> str:
    """Rule hits from joined clauses and numeric claims, one UNION branch per rule."""
    branches = []
    for order, rule in enumerate(pack.RULES):
        cue = [has_sql("w_det", pack.ATOMS[a]) for a in rule.cue]
        cue += [f"NOT {has_sql('w_det', pack.ATOMS[a])}" for a in rule.cue_not]
        if rule.rule_id == "outsized":
            cue = ["n.kind IS NOT NULL"]
        ask = " AND ".join(has_sql("w_det", pack.ATOMS[a]) for a in rule.ask) or "true"
        gate = pack.CONTEXT_GATES.get(rule.rule_id)
        quiet = cautioned_sql("w_det", rule.rule_id)
        join = f"LEFT JOIN {claims} n USING (msg_id, clause_no)" if rule.rule_id == "outsized" else ""
        ordinary = (
            ordinary_deadline_sql("w_det", "coalesce(prev_det, '')", "coalesce(next_det, '')")
            if rule.rule_id == "urgency" else "false"
        )
        branches.append(
            f"SELECT c.msg_id, c.clause_no, {order} AS rule_no, {sql_literal(rule.rule_id)} AS rule_id, "
            f"{sql_literal(rule.severity)} AS base_severity, {sql_literal(rule.family)} AS family, "
            f"{rule.is_action} AS is_action, {rule.is_scoped} AS is_scoped, w_start, w_end, "
            f"{'true' if gate is None else has_sql('c.text', gate)} AS in_context, {quiet} AS cautioned, "
            f"({ask}) AND NOT {quiet} AS soliciting, {ordinary} AS ordinary, "
            f"substr(c.text, CAST(w_start AS BIGINT) + 1, CAST(w_end - w_start AS BIGINT)) AS original "
            f"FROM {clauses} c {join} WHERE {' AND '.join(cue)}"
        )
    return " UNION ALL ".join(branches)


def findings_sql(hits: str, excerpt: str = "original") -> str:
    return f"""
SELECT msg_id, rule_no, rule_id, family, is_action, is_scoped, clause_no, w_start, w_end, soliciting,
       CASE WHEN worse = 1 THEN 'context' ELSE base_severity END AS severity, 'local' AS origin,
       substr({excerpt}, 1, {EXCERPT_LIMIT}) AS excerpt
FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, rule_id ORDER BY worse, clause_no) AS pick
      FROM (SELECT *, CASE WHEN rule_id = 'urgency' THEN CAST(ordinary AS INTEGER)
                           WHEN is_scoped THEN CAST(NOT soliciting AS INTEGER) ELSE 0 END AS worse
            FROM {hits} WHERE in_context AND NOT cautioned))
WHERE pick = 1"""


def risk_sql(found: str) -> str:
    counted = "severity = 'attention' AND soliciting AND rule_id <> 'pattern-match'"
    return f"""
SELECT msg_id, n_findings, reasons, n_reasons, n_families,
       CASE WHEN n_families >= 2 AND coalesce(supported, false) THEN 'strong' WHEN n_reasons > 0 THEN 'potential' ELSE 'insufficient' END AS level
FROM (SELECT msg_id, count(*) AS n_findings, count(DISTINCT rule_id) FILTER (severity = 'attention') AS n_reasons,
             string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER (severity = 'attention') AS reasons,
             count(DISTINCT family) FILTER ({counted}) AS n_families
      FROM {found} GROUP BY msg_id)
LEFT JOIN (SELECT a.msg_id, bool_or(f.family <> a.family AND NOT (a.family = 'fee-demand' AND f.family = 'return-promise')) AS supported
           FROM (SELECT DISTINCT msg_id, family FROM {found} WHERE {counted} AND is_action AND origin <> 'ai') a
           JOIN (SELECT DISTINCT msg_id, family FROM {found} WHERE {counted}) f USING (msg_id)
           GROUP BY a.msg_id) USING (msg_id)"""


def rules_dim(spark) -> DataFrame:
    return dim(spark, pack.RULE_COLUMNS, _rule_rows())


def rules_dim_sql() -> str:
    return dim_sql(pack.RULE_COLUMNS, _rule_rows())


def _rule_rows() -> list[tuple]:
    return [(r.rule_id, r.severity, r.family, r.is_action, r.is_scoped, r.concept_id, r.source_ids) for r in pack.RULES]
