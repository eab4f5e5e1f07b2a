"""Data-quality jobs: expectations, uniqueness, references, robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, expectations: dict[str, Column]) -> DataFrame:
    """Rows that fail, with the names of every failed expectation; a null test counts as failed."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in expectations.items()])
    )
    return rows.select(key, failed.alias("reasons")).where(F.size("reasons") > 0)


def repeated(rows: DataFrame, key: Column, ident: str) -> DataFrame:
    """Keys shared by several rows; only a count and the smallest id are kept per key."""
    return (
        rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(ident).alias("first_id")).where("n > 1")
    )


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str, edge: str) -> DataFrame:
    """How many rows of an edge point nowhere, next to how many there are.

    References are counted per value before they meet the parent, so one value
    with a third of all rows is a single row in the join.
    """
    counted = child.groupBy(F.col(column).alias("ref")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(key).alias("ref")).distinct().withColumn("known", F.lit(True))
    return counted.join(known, "ref", "left").agg(
        F.lit(edge).alias("edge"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_refs"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_dangling"),
    )


def match_summary(rows: DataFrame, key: str) -> DataFrame:
    """Expected-category matches and false alarms per key, with rows outside the scoring counted apart.

    ``rows`` has (assessable, expected, category, reason_ids, n_findings). Risky rows are
    those that expect a warning; the other assessable rows are controls. Shares are
    null where nothing can be divided.
    """
    scored, risky = F.col("assessable"), F.col("assessable") & F.col("expected")
    control = scored & ~F.col("expected")
    warned, found = F.size("reason_ids") > 0, F.col("n_findings") > 0
    counts = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(risky).alias("n_risky"), F.count_if(risky & warned).alias("risky_warned"),
        F.count_if(risky & F.array_contains("reason_ids", F.col("category"))).alias("risky_matched"),
        F.count_if(control).alias("n_controls"), F.count_if(control & warned).alias("controls_warned"),
        F.count_if(control & found).alias("controls_found"),
        F.count_if(~scored).alias("n_not_assessable"), F.count_if(~scored & found).alias("not_assessable_found"),
    )

    def share(part: str, whole: Column) -> Column:
        return F.round(F.col(part) / F.when(whole > 0, whole), 6)

    return counts.withColumns({
        "precision": share("risky_warned", F.col("risky_warned") + F.col("controls_warned")),
        "recall": share("risky_warned", F.col("n_risky")),
        "false_alarms": share("controls_warned", F.col("n_controls")),
    })


# Formatting changes that must not change what is found: (name, column function, SQL over ``text``).
PERTURBATIONS = [
    ("double spaces", lambda t: F.replace(t, F.lit(" "), F.lit("  ")), "replace(text, ' ', '  ')"),
    ("trailing spaces", lambda t: F.concat(t, F.lit("   ")), "text || '   '"),
    ("line breaks", lambda t: F.replace(t, F.lit(". "), F.lit(".\n")), "replace(text, '. ', '.' || chr(10))"),
    ("upper case", lambda t: F.upper(t), "upper(text)"),
    ("stars between letters", lambda t: F.replace(t, F.lit("to"), F.lit("t*o")), "replace(text, 'to', 't*o')"),
]
