"""The learner of quality rules on real labels, and its counts against plain counting."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from assayer.llm import quality_rules as q
from assayer.llm.common import documents, read_table

LARGER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs labelled documents")
def test_rules_from_labels(spark):
    judged = q.judge(documents(spark, LARGER), read_table(spark, LARGER, "labels"))
    rows = judged.where("NOT base_failed").join(read_table(spark, LARGER, "labels"), "doc_id").where("quality IS NOT NULL")
    got = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    bad, good = got.get((0, False), 0) + got.get((0, True), 0), got.get((1, False), 0) + got.get((1, True), 0)
    assert got[0, False] >= 0.9 * bad > 0 and got[1, True] >= 0.95 * good > 0


def test_choices_against_counting(spark):
    rows = [(k % 3 == 0, k % 4 == 0 or k > 50, k % 7, (k * k) % 5) for k in range(70)]
    table = spark.createDataFrame(rows, "prunes boolean, bad boolean, b_x int, b_y int")
    cuts = {"x": [float(v) for v in range(1, 7)], "y": [float(v) for v in range(1, 5)]}
    for choice in q._choices(q._counts(table, list(cuts)), cuts):
        at = 2 + list(cuts).index(choice.condition.feature)
        for prunes, counts in ((False, choice.grown), (True, choice.pruned)):
            side = [r for r in rows if r[0] == prunes and (r[at] >= choice.condition.threshold) == choice.condition.above]
            assert counts == (sum(r[1] for r in side), sum(not r[1] for r in side))


def test_a_failed_candidate_does_not_end_learning(spark, docs_of):
    # Exclamations part most bad rows, but not well enough; a few more have signs that no good row has.
    rows, marks = [], []
    for k in range(300):
        words = [f"w{k}x{j}" for j in range(60)]
        bad = k % 3 == 0
        if bad and k % 2 or not bad and k % 7 == 0:
            words[0] += "!!!"
        if bad and not k % 2:
            words[1] += "##"
        rows.append((k, " ".join(words)))
        marks.append((k, 0 if bad else 1))
    judged = q.judge(docs_of(rows), spark.createDataFrame(marks, "doc_id long, quality int"))
    caught = {r.doc_id for r in judged.where(F.col("rule").contains("symbols_per_word")).collect()}
    assert caught == {k for k in range(300) if k % 6 == 0}
