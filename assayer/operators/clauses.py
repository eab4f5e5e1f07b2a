"""The clause model: sentence and conjunction splits, neighbours, quotes, joins.

Everything about one message stays in its row: clauses are an array until they
are exploded, so neighbours need neither a window nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.core.dims import sql_literal
from assayer.core.regex import bind, folded, has_sql, once, starts
from assayer.functions.literals import UNKNOWN
from assayer.functions.text import detection_text
from assayer.packs.rules import ATOMS, CONTINUATIONS, NEIGHBOUR_LIMIT
from assayer.packs.turns import ABOUT_QUOTE, CONJUNCTION, LESSON, NEW_REQUEST, QUOTE, SWITCH, TURNED_DOWN

# Noncharacters that mark the end of a clause and the end of its separator.
STOP, NEXT = "﷐", "﷑"


def marked(text: Column, conjunctions: bool = True) -> Column:
    text = F.regexp_replace(text, r"([!?।;])(\s*)", f"$1{STOP}$2{NEXT}")
    text = F.regexp_replace(text, r"\.(?=\s|$)", f"{STOP}.{NEXT}")
    if conjunctions:
        text = F.regexp_replace(text, f"(?iu)({CONJUNCTION})(?={NEW_REQUEST})", f"{STOP}$1{NEXT}")
    return text


def marked_sql(column: str, conjunctions: bool = True) -> str:
    def replace(source: str, pattern: str, target: str) -> str:
        return f"regexp_replace({source}, {sql_literal(pattern)}, {sql_literal(target)}, 'g')"

    column = replace(column, r"([!?।;])(\s*)", f"\\1{STOP}\\2{NEXT}")
    column = replace(column, r"\.(\s|$)", f"{STOP}.{NEXT}\\1")
    if conjunctions:
        column = replace(column, f"(?i)({CONJUNCTION})({NEW_REQUEST})", f"{STOP}\\1{NEXT}\\2")
    return column


def clause_array(text: Column, conjunctions: bool = True) -> Column:
    """Array of (start, end, clause) with zero-based code-point offsets into ``text``."""
    pieces = F.split(marked(text, conjunctions), NEXT, -1)

    def walked(parts: Column) -> Column:
        begins = starts(F.transform(parts, lambda p: F.length(p) - F.when(p.contains(STOP), 1).otherwise(0)))

        def one(part: Column, at: Column) -> Column:
            clause = F.split_part(part, F.lit(STOP), F.lit(1))
            return F.struct(at.alias("start"), (at + F.length(clause)).alias("end"), clause.alias("clause"))

        return F.zip_with(parts, begins, one)

    return F.filter(bind(pieces, walked), lambda c: c["clause"] != "")


@once
def _detected(conjunctions: bool, mask_quotes: bool) -> Column:
    def detect(c: Column, shown: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["clause"].alias("clause"), detection_text(shown).alias("det"))

    clauses = clause_array(F.col("text"), conjunctions)
    if not mask_quotes:
        return F.transform(clauses, lambda c: detect(c, c["clause"]))
    # Bound, as a column would be copied into the step and quotes looked for once in every clause.
    return bind(
        quote_masked(F.col("text")),
        lambda quiet: F.transform(clauses, lambda c: detect(c, F.substring(quiet, c["start"] + 1, c["end"] - c["start"]))),
    )


def clause_rows(messages: DataFrame, conjunctions: bool = True, mask_quotes: bool = False) -> DataFrame:
    """Messages with ``_cl``, the array of their clauses and matching copies."""
    return messages.withColumn("_cl", _detected(conjunctions, mask_quotes))


@once
def with_neighbours() -> Column:
    return F.transform(
        "_cl",
        lambda c, i: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["clause"].alias("clause"), c["det"].alias("det"),
            F.get("_cl", i - 1).alias("prev"), F.get("_cl", i + 1).alias("next"),
        ),
    )


def split_clauses(messages: DataFrame, conjunctions: bool = True, mask_quotes: bool = False) -> DataFrame:
    """One row per clause: offsets, text, matching copy and both neighbours' copies."""
    base = clause_rows(messages, conjunctions, mask_quotes)
    near = with_neighbours()
    kept = [c for c in messages.columns if c != "quiet"]
    return base.select(*kept, F.posexplode(near).alias("clause_no", "_c")).select(
        *kept, "clause_no", "_c.start", "_c.end", "_c.clause", "_c.det",
        F.col("_c.prev.det").alias("prev_det"), F.col("_c.next.det").alias("next_det"),
        F.col("_c.prev.start").alias("prev_start"), F.col("_c.next.end").alias("next_end"),
    )


def clauses_sql(source: str, conjunctions: bool = True, det: str = "clause") -> str:
    """The same rows from a relation with msg_id and text, by window functions.

    ``det`` is the matching copy, written over ``clause``, ``start`` and ``quiet``.
    """
    return f"""
SELECT *, lag(det) OVER w AS prev_det, lead(det) OVER w AS next_det,
       lag(start) OVER w AS prev_start, lead("end") OVER w AS next_end
FROM (SELECT *, {det} AS det, start + length(clause) AS "end",
             CAST(row_number() OVER (PARTITION BY msg_id ORDER BY piece_no) - 1 AS INTEGER) AS clause_no
      FROM (SELECT *, CAST(coalesce(sum(width) OVER (PARTITION BY msg_id ORDER BY piece_no
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM (SELECT *, string_split(piece, {sql_literal(STOP)})[1] AS clause,
                         length(piece) - CASE WHEN contains(piece, {sql_literal(STOP)}) THEN 1 ELSE 0 END AS width
                  FROM (SELECT *, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS piece_no
                        FROM (SELECT *, string_split({marked_sql('text', conjunctions)}, {sql_literal(NEXT)}) AS pieces
                              FROM {source}))))
      WHERE clause <> '')
WINDOW w AS (PARTITION BY msg_id ORDER BY clause_no)"""


def _all(column: Column, atoms: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for atom in atoms:
        test = test & column.rlike(folded(ATOMS[atom]))
    return test


def _all_sql(column: str, atoms: tuple[str, ...]) -> str:
    return " AND ".join(has_sql(column, ATOMS[a]) for a in atoms)


def joined_clauses(clauses: DataFrame, rejected) -> DataFrame:
    """Widen a clause to its neighbour when one depends on the other.

    ``rejected`` maps a lower-case text column to a boolean: a clause that is
    already a caution never pulls its neighbour in.
    """
    det = F.col("det")
    nxt, prv = (F.coalesce(name, F.lit("")) for name in ("next_det", "prev_det"))
    lows = clauses.select(
        "*", F.lower("det").alias("_low"), F.lower(nxt).alias("_low_next"), F.lower(prv).alias("_low_prev")
    )
    low, low_next, low_prev = F.col("_low"), F.col("_low_next"), F.col("_low_prev")
    forward, back = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, first, then, looks_back in reversed(CONTINUATIONS):
        forward = F.when(_all(low, first) & _all(low_next, then), name).otherwise(forward)
        if looks_back:
            back = F.when(_all(low_prev, first) & _all(low, then), name).otherwise(back)
    # The dependency is rarely present, so it is tested before the cautions.
    linked = lows.select("*", forward.alias("_may_forward"), back.alias("_may_back"))
    short = F.length("det") <= NEIGHBOUR_LIMIT

    def allowed(candidate: str, near: Column, low_near: Column) -> Column:
        fits = short & (near != "") & (F.length(near) <= NEIGHBOUR_LIMIT)
        return F.when(
            F.col(candidate).isNotNull() & fits & ~rejected(low) & ~rejected(low_near), F.col(candidate)
        )

    return (
        linked.withColumns({
            "_back": allowed("_may_back", prv, low_prev), "_forward": allowed("_may_forward", nxt, low_next),
        })
        .withColumns({
            "joined_by": F.coalesce("_back", "_forward"),
            "w_start": F.when(F.col("_back").isNotNull(), F.col("prev_start")).otherwise(F.col("start")),
            "w_end": F.when(F.col("_back").isNull() & F.col("_forward").isNotNull(), F.col("next_end"))
            .otherwise(F.col("end")),
            "w_det": F.when(F.col("_back").isNotNull(), F.concat_ws(" ", prv, det))
            .when(F.col("_forward").isNotNull(), F.concat_ws(" ", det, nxt)).otherwise(det),
        })
        .drop("_back", "_forward", "_may_back", "_may_forward", "_low", "_low_next", "_low_prev")
    )


def widened(clause: Column, test: Callable[[Column, tuple[str, ...]], Column], rejected: Callable[[Column], Column]) -> Column:
    """(w_start, w_end, w_det, mask, prev_det, next_det) of one clause with its neighbours: ``joined_clauses`` inside the row.

    ``clause`` has ``own``, ``prev`` and ``next``: (start, end, det, mask), a missing neighbour with nulls. ``test`` finds atoms
    in one of them. A dependency is rarely present, so it is tested before the cautions. Nothing is known of two joined texts.
    """
    own, prv, nxt = (clause[n] for n in ("own", "prev", "next"))
    forward = back = F.lit(False)
    for _, first, then, looks_back in CONTINUATIONS:
        forward = forward | (test(own, first) & test(nxt, then))
        if looks_back:
            back = back | (test(prv, first) & test(own, then))

    def allowed(candidate: Column, near: Column) -> Column:
        fits = (F.length(own["det"]) <= NEIGHBOUR_LIMIT) & (near["det"] != "") & (F.length(near["det"]) <= NEIGHBOUR_LIMIT)
        return fits & candidate & ~rejected(own) & ~rejected(near)

    def window(side: Column) -> Column:
        return F.struct(
            F.when(side == -1, prv["start"]).otherwise(own["start"]).alias("w_start"),
            F.when(side == 1, nxt["end"]).otherwise(own["end"]).alias("w_end"),
            F.when(side == -1, F.concat_ws(" ", prv["det"], own["det"])).when(side == 1, F.concat_ws(" ", own["det"], nxt["det"]))
            .otherwise(own["det"]).alias("w_det"),
            F.when(side == 0, own["mask"]).otherwise(F.lit(UNKNOWN)).alias("mask"),
            prv["det"].alias("prev_det"), nxt["det"].alias("next_det"),
        )

    return bind(F.when(allowed(back, prv), -1).when(allowed(forward, nxt), 1).otherwise(0), window)


def joined_sql(source: str, rejected) -> str:
    det, nxt, prv = "det", "coalesce(next_det, '')", "coalesce(prev_det, '')"
    limit = NEIGHBOUR_LIMIT
    live = f"length({det}) <= {limit} AND NOT ({rejected(det)})"
    ahead = " ".join(
        f"WHEN {_all_sql(det, first)} AND {_all_sql(nxt, then)} THEN {sql_literal(name)}"
        for name, first, then, _ in CONTINUATIONS
    )
    behind = " ".join(
        f"WHEN {_all_sql(prv, first)} AND {_all_sql(det, then)} THEN {sql_literal(name)}"
        for name, first, then, looks_back in CONTINUATIONS if looks_back
    )
    return f"""
SELECT *, coalesce(back, forward) AS joined_by,
       CASE WHEN back IS NOT NULL THEN prev_start ELSE start END AS w_start,
       CASE WHEN back IS NULL AND forward IS NOT NULL THEN next_end ELSE "end" END AS w_end,
       CASE WHEN back IS NOT NULL THEN {prv} || ' ' || det WHEN forward IS NOT NULL THEN det || ' ' || {nxt} ELSE det END AS w_det
FROM (SELECT *,
        CASE WHEN {live} AND {nxt} <> '' AND length({nxt}) <= {limit} AND NOT ({rejected(nxt)})
             THEN CASE {ahead} END END AS forward,
        CASE WHEN {live} AND {prv} <> '' AND length({prv}) <= {limit} AND NOT ({rejected(prv)})
             THEN CASE {behind} END END AS back
      FROM {source})"""


# --- quotes -------------------------------------------------------------------


def quote_masked(text: Column) -> Column:
    """Blank quoted examples that their own surroundings frame and reject.

    The text is cut into the quotes and the plain text around them. A quote is judged by
    the sentence before it and the sentence right after it, nothing further away. A
    lesson is named in the introduction or in a statement about the quote; what turns
    back to a live offer afterwards leaves the quote as it is.
    """
    def quiet(plain: Column, quote: Column, i: Column) -> Column:
        intro = F.regexp_extract(F.get(plain, i), r"([^.!?।;\n]*)$", 1)
        follow = F.regexp_extract(F.get(plain, i + 1), r"^[\s.!?।;]*([^.!?।\n]*)", 1)
        framed = intro.rlike(LESSON) | (follow.rlike(ABOUT_QUOTE) & follow.rlike(LESSON))
        rejected = intro.rlike(TURNED_DOWN) | follow.rlike(TURNED_DOWN)
        live = follow.rlike(SWITCH)
        return F.when(framed & rejected & ~live, F.repeat(F.lit(" "), F.length(quote))).otherwise(quote)

    def weave(plain: Column) -> Column:
        quotes = F.transform(
            F.regexp_extract_all(text, F.lit(QUOTE), F.lit(0)), lambda quote, i: quiet(plain, quote, i)
        )
        return F.array_join(
            F.zip_with(plain, quotes, lambda p, quote: F.concat(p, F.coalesce(quote, F.lit("")))), ""
        )

    return F.when(text.rlike(QUOTE), bind(F.split(text, QUOTE, -1), weave)).otherwise(text)
