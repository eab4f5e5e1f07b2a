"""End-to-end screening of whole documents with a data lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import masked
from assayer.operators.clauses import clause_array
from assayer.packs.lexicon import LEXICON


def lexicon_hits(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Theta join of clauses and lexicon, with one literal test per entry.

    The whole text is tested first, so documents without any hit are never split.
    """
    text = F.col("text")
    worth = F.lit(False)
    for entry in LEXICON:
        worth = worth | text.rlike(entry[4])
    clauses = messages.where(worth).select(
        "msg_id", *keep, F.posexplode(clause_array(text, conjunctions=False)).alias("clause_no", "c")
    )
    tests = [
        F.when(
            F.col("c.clause").rlike(pattern),
            F.struct(
                F.lit(rule).alias("rule_id"), F.lit(family).alias("family"),
                F.lit(severity).alias("severity"), F.lit(action).alias("is_action"),
            ),
        )
        for rule, family, severity, action, pattern in LEXICON
    ]
    return clauses.select(
        "msg_id", *keep, "clause_no", F.col("c.clause").alias("clause"),
        F.explode(F.array_compact(F.array(*tests))).alias("r"),
    ).select("msg_id", *keep, "clause_no", "clause", "r.*")


def lexicon_findings(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """First matching clause per message and rule, masked for display."""
    first = F.min(F.struct("clause_no", "clause")).alias("f")
    picked = lexicon_hits(messages, keep).groupBy("msg_id", *keep, "rule_id", "family", "severity", "is_action").agg(first)
    return picked.select(
        "msg_id", *keep, "rule_id", "family", "severity", "is_action", F.col("f.clause_no").alias("clause_no"),
        masked(F.col("f.clause")).alias("excerpt"),
    )


def lexicon_tiers(messages: DataFrame) -> DataFrame:
    """Tier per document: two warning families, one of them actionable, are strong."""
    hits = lexicon_hits(messages, ("lang",)).select("msg_id", "lang", "family", "severity", "is_action").distinct()
    attention = F.col("severity") == "attention"
    per = hits.groupBy("msg_id").agg(
        F.count_distinct(F.when(attention, F.col("family"))).alias("n_families"),
        F.bool_or(attention & F.col("is_action")).alias("acts"),
    )
    level = (
        F.when((F.col("n_families") >= 2) & F.col("acts"), "strong")
        .when(F.col("n_families") >= 1, "potential").otherwise("insufficient")
    )
    return messages.select("msg_id", "lang").join(per, "msg_id", "left").select("msg_id", "lang", level.alias("level"))


def tier_rollup(tiers: DataFrame) -> DataFrame:
    """Counts per language and tier, with subtotals and a grand total."""
    return tiers.rollup("lang", "level").agg(F.count("*").alias("n")).select(
        F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("level", F.lit("ALL")).alias("level"), "n"
    )
