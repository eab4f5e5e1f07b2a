"""Regex helpers.

Patterns meant for both Spark (Java regex) and the SQL oracle (RE2) keep to the
syntax the two share: no look-around, no ``\\b``, code points as ``\\x{..}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.core.dims import sql_literal

# An ASCII word boundary: Java's own \b also counts other letters as word characters.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


_BUILT: dict = {}


def once(build: Callable) -> Callable:
    """Keep a built column for the life of the JVM connection.

    Building a large expression takes thousands of small calls to the JVM, and a
    column over named inputs is the same for every query.
    """

    @wraps(build)
    def get(*args):
        gateway = SparkContext._gateway
        known = _BUILT.setdefault((build.__module__, build.__qualname__, args), (gateway, None))
        if known[0] is not gateway or known[1] is None:
            known = _BUILT[(build.__module__, build.__qualname__, args)] = (gateway, build(*args))
        return known[1]

    return get


def words(*alternatives: str) -> str:
    """Whole Latin words, case-insensitively, without look-around."""
    return r"(?i)(?:^|[^a-z])(?:" + "|".join(alternatives) + r")(?:$|[^a-z])"


def folded(pattern: str) -> str:
    """The same pattern for text that is already lower-case.

    Matching without case folding is several times faster, so hot paths lower the
    text once and use this form. Escapes and property names keep their case.
    """
    out = re.sub(r"\\[pP]\{[^}]*\}|\\.|[A-Z]", lambda m: m[0] if len(m[0]) > 1 else m[0].lower(), pattern)
    return out.replace("(?i)", "")


def anyof(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def has(column: Column, pattern: str) -> Column:
    return column.rlike(pattern)


def has_sql(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {sql_literal(pattern)})"


def count_of(column: Column, pattern: str) -> Column:
    return F.regexp_count(column, F.lit(pattern))


def find_all(column: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` under a name.

    A step that mentions its input several times would otherwise copy the whole
    expression below it at every mention. The value is the start of a fold: taking it
    out of an array of one would work out the type of the whole step in every row.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda bound, _: bound, fn)


#: Values that one fold adds up; a fold copies its array at every step.
_BLOCK = 64


def starts(lengths: Column) -> Column:
    """Where each part begins, from the parts' lengths.

    Sums run inside blocks, and over the blocks' totals, so a text with many parts
    costs in proportion to them.
    """

    def running(values: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            values, empty,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, n: acc + n)

    def blocks(values: Column) -> Column:
        count = F.floor((F.size(values) + (_BLOCK - 1)) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.slice(values, (k - 1) * _BLOCK + 1, _BLOCK))

    def join(parts: Column) -> Column:
        shifted = F.zip_with(
            F.transform(parts, running), running(F.transform(parts, total)), lambda own, shift: F.transform(own, lambda at: at + shift)
        )
        return F.flatten(shifted)

    return bind(lengths, lambda values: F.when(F.size(values) <= _BLOCK, running(values)).otherwise(bind(blocks(values), join)))


def positions(column: Column, pattern: str) -> Column:
    """Array of (pos, hit): zero-based offset and text of every match.

    Spark returns the matched texts and, by splitting, the texts between them;
    running lengths of the two give each offset without leaving the JVM.
    """
    def found(hits: Column) -> Column:
        gaps = F.slice(F.split(column, pattern, -1), 1, F.size(hits))
        parts = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
        return F.when(F.size(hits) > 0, bind(parts, placed)).otherwise(F.array().cast("array<struct<pos:int,hit:string>>"))

    def placed(cut: Column) -> Column:
        begins = starts(F.transform(cut, lambda p: p["gap"] + F.length(p["hit"])))
        return F.zip_with(cut, begins, lambda p, at: F.struct((at + p["gap"]).alias("pos"), p["hit"].alias("hit")))

    return bind(find_all(column, pattern), found)
