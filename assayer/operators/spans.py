"""Span operators inside one message: merge overlaps, find every occurrence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_spans(spans: Column, touching: bool) -> Column:
    """Merge overlapping (start, end) spans; with ``touching`` also adjacent ones.

    The spans of a message are an array in its row: sorted once, folded once.
    Starts ascend and longer spans come first, so the last merged span is the
    only one a new span can meet.
    """
    order = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus")))),
        lambda s: F.struct(s["start"].alias("start"), (-s["minus"]).alias("end")),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def fold(acc: Column, span: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        meets = (span["start"] <= last["end"]) if touching else (span["start"] < last["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.coalesce(meets, F.lit(False)), F.concat(head, F.array(grown))).otherwise(
            F.concat(acc, F.array(F.struct(span["start"].alias("start"), span["end"].alias("end"))))
        )

    return F.aggregate(order, empty, fold)


def occurrences(text: Column, excerpt: Column) -> Column:
    """Zero-based offsets of every occurrence of ``excerpt``, overlapping ones included.

    Splitting before each place the excerpt starts leaves pieces whose running
    lengths are the offsets.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(excerpt, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(text, quoted, -1)
    starts = F.aggregate(
        F.transform(pieces, F.length),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    found = F.when(text.startswith(excerpt), starts).otherwise(F.slice(starts, F.lit(2), F.size(starts)))
    return F.when((F.length(excerpt) > 0) & F.contains(text, excerpt), found).otherwise(F.array().cast("array<int>"))
