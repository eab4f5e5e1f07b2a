"""Spans, budgets, merging, sources and plans on small hand-made inputs."""

import json

import pytest
import os
import random

from pyspark.sql import functions as F

from assayer.core.session import shared_dir
from assayer.operators import retrieval, review, spans
from assayer.plans.catalog import queries
from assayer.sources import messages, saved


def test_merge_spans_against_brute_force(spark):
    rng = random.Random(7)
    cases = [[(s, s + rng.randint(1, 6)) for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 12)))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i INT, spans ARRAY<STRUCT<start: INT, end: INT>>")
    out = rows.select("i", spans.merge_spans(F.col("spans"), False).alias("a"), spans.merge_spans(F.col("spans"), True).alias("b"))
    for r in out.collect():
        for touching, got in ((False, r.a), (True, r.b)):
            want = []
            for s, e in sorted(cases[r.i], key=lambda x: (x[0], -x[1])):
                if want and (s <= want[-1][1] if touching else s < want[-1][1]):
                    want[-1][1] = max(want[-1][1], e)
                else:
                    want.append([s, e])
            assert [[x.start, x.end] for x in got] == want


def test_occurrences_overlap(spark):
    cases = [("aaaa", "aa"), ("abcabc", "abc"), ("xx", "y"), ("a.b.a.b", "a.b"), ("नमनम", "नम"), ("q", "")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, text STRING, excerpt STRING")
    got = {r.i: r.o for r in rows.select("i", spans.occurrences(F.col("text"), F.col("excerpt")).alias("o")).collect()}
    for i, (text, excerpt) in enumerate(cases):
        want = [k for k in range(len(text)) if excerpt and text.startswith(excerpt, k)]
        assert got[i] == want


def test_greedy_budget_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(q, f"d{d:03d}", round(rng.uniform(1, 9), 2), rng.randint(1, 60)) for q in range(12) for d in range(rng.randint(0, 40))]
    df = spark.createDataFrame(rows, "q_id BIGINT, doc_id STRING, score DOUBLE, size INT")
    got = {}
    for r in retrieval.greedy_budget(df, 4, 90).orderBy("q_id", "pick").collect():
        got.setdefault(r.q_id, []).append(r.doc_id)
    want = {}
    for q in range(12):
        used, kept = 2, []
        for _, doc, _, size in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            cost = used + size + (1 if kept else 0)
            if len(kept) < 4 and cost <= 90:
                used, kept = cost, [*kept, doc]
        if kept:
            want[q] = kept
    assert got == want


def test_merge_prefers_local_and_never_drops(spark):
    shape = "msg_id BIGINT, rule_id STRING, severity STRING, origin STRING, excerpt STRING"
    local = spark.createDataFrame([(1, "tip", "attention", "local", "a")], shape)
    online = spark.createDataFrame([(1, "tip", "context", "ai", "b"), (2, "nav", "context", "ai", "c")], shape)
    got = sorted(tuple(r) for r in review.merge_findings(local, online).collect())
    assert got == [(1, "tip", "attention", "local", "a"), (2, "nav", "context", "ai", "c")]
    empty = spark.createDataFrame([], shape)
    assert review.merge_findings(local, empty).count() == 1


def test_incomplete_decisions_void_the_review(spark):
    proposals = spark.createDataFrame([(m, i) for m in (1, 2, 3, 4) for i in (0, 1)], "msg_id BIGINT, idx INT")
    decisions = spark.createDataFrame(
        [(1, 0, "confirm"), (1, 1, "reject"), (2, 0, "confirm"), (3, 0, "reject"), (3, 0, "reject"), (4, 0, "reject"), (4, 1, "reject")],
        "msg_id BIGINT, idx INT, decision STRING",
    )
    got = {r.msg_id: (r.n_confirmed, r.withdrawals_stand) for r in review.decide(proposals, decisions).collect()}
    assert got == {1: (1, False), 4: (0, True)}


def test_json_roots_and_labels(spark, tmp_path):
    item = {"id": "a", "text": "x", "expectAttention": True}
    files = {
        "list.json": [item, {"id": "b", "text": "y", "group": "benign", "expected": {"maxFindings": 0}}],
        "items.json": {"items": [{"id": "c", "text": "z", "riskIntent": "strong-scam-signals"}]},
        "cases.json": {"cases": [{"id": "d", "text": "w", "group": "scam", "scored": False}, {"id": "e", "text": "v", "expectedAttention": False}]},
    }
    files["other.json"] = {"title": "set", "items": [], "messages": [{"id": "f", "text": "u", "expectAttention": "not a label"}], "more": [{"id": "g"}]}
    files["empty.json"] = []
    for name, data in files.items():
        (tmp_path / name).write_text(json.dumps(data, indent=2))
    rows = messages.json_messages(spark, str(tmp_path))
    labelled = rows.withColumn("label", messages.harmonised_label(rows))
    assert {r.id: r.label for r in labelled.collect()} == {
        "a": True, "b": False, "c": True, "d": None, "e": False, "f": None,
    }
    (tmp_path / "none.json").write_text('{"title": "no list"}')
    with pytest.raises(Exception, match="no list of messages"):
        messages.json_messages(spark, str(tmp_path)).collect()


def test_saved_checks(spark):
    shape = "user_id BIGINT, check_id BIGINT, saved_at INT, event_id BIGINT, value DOUBLE"
    stored = spark.createDataFrame([(1, 1, 9, 1, 1.0), (1, 2, 1, 2, 2.0)], shape)
    incoming = spark.createDataFrame([(1, 1, 5, 3, 3.0)], shape)
    got = sorted((r.check_id, r.value) for r in saved.upsert(stored, incoming).collect())
    assert got == [(1, 3.0), (2, 2.0)]
    path = shared_dir(spark, "test-split-rows")
    saved.write_split(spark.createDataFrame([(1, "a" * 70000), (2, "b"), (3, None)], "id INT, text STRING"), ["text"], path)
    assert {r.id: r.accepted for r in spark.read.parquet(path).collect()} == {1: "false", 2: "true", 3: "false"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_joins_and_prune_columns(spark, folder):
    registered = queries()
    for name in ("jn4_first_match", "agg1_risk_tiers", "cls8_corroborated_findings", "ret2_bm25", "ret5_rank_contrast_pairs",
                 "jn7_merge_finding_sets", "jn9_valid_citations", "mdl7_batch_score", "snk1_upsert_saved_checks"):
        plan = _plan(registered[name](spark, folder))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    plan = _plan(registered["agg7_held_out_summary"](spark, folder))
    assert "text" not in plan
    # The rank limit works before the shuffle as well as after it.
    assert _plan(registered["snk2_newest_fifty_per_user"](spark, folder)).count("WindowGroupLimit") == 2


def test_library_never_cuts_lineage_locally():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "assayer")
    for where, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                source = open(os.path.join(where, name), encoding="utf-8").read()
                assert "local" + "Checkpoint" not in source and "crossJoin" not in source, name


def test_counters_saturate(spark, folder):
    from assayer.core.session import read_table
    from assayer.plans.queries_aggregates import COUNTER_LIMIT, counters

    events = read_table(spark, folder, "events")
    free, held = ({(r.dimension, r.bucket): r.n for r in counters(events, n).collect()} for n in (COUNTER_LIMIT, 7))
    assert max(free.values()) > 7 and held == {k: min(n, 7) for k, n in free.items()}


def test_text_walks_are_linear(spark):
    import time

    from assayer.core.regex import positions, starts
    from assayer.operators.clauses import clause_array

    lengths = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: (k % 7).cast("int")).alias("n"))
    got = lengths.select(starts(F.col("n")).alias("s")).first().s
    assert got == [sum(k % 7 for k in range(i)) for i in range(1000)]

    def seconds(n):
        text = spark.createDataFrame([("Word and word. " * n,)], "text string")
        begin = time.perf_counter()
        row = text.select(F.size(clause_array(F.col("text"))).alias("c"), F.size(positions(F.col("text"), "and")).alias("p")).first()
        assert row.c >= n and row.p == n
        return time.perf_counter() - begin

    seconds(100)
    short, long = seconds(10_000), seconds(40_000)
    assert long < 8 * short + 2


def test_top_scores_are_the_head_of_the_full_ranking(spark):
    import random

    rng = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for i in range(400)] + [(900, "word0"), (901, "word0"), (902, None)]
    asks = [(q, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for q in range(40)] + [(98, "word0"), (99, "unknown")]
    corpus = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    asked = retrieval.asked_tokens(spark.createDataFrame(asks, "q_id BIGINT, text STRING"), "q_id")
    postings = retrieval.index(corpus)
    for k in (1, 5):
        got = {(r.q_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.top_scores(asked, postings, corpus, k).collect()}
        full = {}
        for r in retrieval.bm25(asked, postings, corpus).collect():
            full.setdefault(r.q_id, []).append((-r.score, r.doc_id))
        want = {(q, i + 1): (d, -s) for q, found in full.items() for i, (s, d) in enumerate(sorted(found)[:k])}
        assert got == want


def test_merge_leaves_other_buckets_alone(spark):
    import os

    shape = "user_id BIGINT, check_id BIGINT, saved_at INT, event_id BIGINT, value DOUBLE"
    path = shared_dir(spark, "test-store")
    saved.create(spark.createDataFrame([(u, c, 1, 10 * u + c, 0.0) for u in range(40) for c in (1, 2)] + [(3, 1, 5, 99, 7.0)], shape), path, 8)

    def files():
        return {(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    got = {(r.user_id, r.check_id): r.value for r in saved.merge(path, spark.createDataFrame([(5, 1, 0, 1, 4.0), (5, 9, 0, 2, 6.0)], shape), 8).collect()}
    assert got == {(u, c): 0.0 for u in range(40) for c in (1, 2)} | {(3, 1): 7.0, (5, 1): 4.0, (5, 9): 6.0}
    changed = {d for d, _ in before ^ files()}
    assert len(changed) == 1 and len({d for d, _ in before}) > 1
    assert saved.merge(path, spark.createDataFrame([], shape), 8).count() == 81
    with pytest.raises(ValueError):
        saved.merge(path, spark.createDataFrame([(5, 1, 0, 1, 4.0)], shape), 7)


def test_match_summary(spark):
    from assayer.operators.quality import match_summary

    rows = [
        ("en", True, True, "a", ["a"], 1), ("en", True, True, "a", ["b"], 1), ("en", True, True, "a", [], 1),
        ("en", True, False, "a", [], 1), ("en", True, False, "a", ["a"], 1), ("en", False, True, "a", ["a"], 2), ("hi", False, True, "a", [], 0),
    ]
    frame = spark.createDataFrame(rows, "lang STRING, assessable BOOLEAN, expected BOOLEAN, category STRING, reason_ids ARRAY<STRING>, n_findings INT")
    got = {r.lang: tuple(r)[1:] for r in match_summary(frame, "lang").collect()}
    assert got == {"en": (6, 3, 2, 1, 2, 1, 2, 1, 1, 0.666667, 0.666667, 0.5), "hi": (1, 0, 0, 0, 0, 0, 0, 1, 0, None, None, None)}


def test_merged_status_speaks_of_both_sides(spark):
    found = "msg_id BIGINT, rule_id STRING, severity STRING, origin STRING, excerpt STRING"
    local = spark.createDataFrame([(1, "nav", "context", "local", "x"), (2, "credentials", "context", "local", "x")], found)
    online = spark.createDataFrame([(1, "credentials", "attention", "ai", "y"), (2, "credentials", "attention", "ai", "y")], found)
    m = spark.createDataFrame([(1,), (2,), (3,)], "msg_id BIGINT")
    got = {r.msg_id: (r.n_findings, r.status, r.sources) for r in review.merged_status(m, review.merge_findings(local, online)).collect()}
    assert got == {1: (2, "attention", "bank-safety,fund-basics"), 2: (1, "context", "bank-safety"), 3: (0, "context", "")}


def test_postings_of_wanted_tokens_give_the_same_ranking(spark):
    texts = [(k, " ".join(f"w{(k * j) % 17}" for j in range(1, 3 + k % 9))) for k in range(60)] + [(60, ""), (61, None), (7, "w1 w1 zz")]
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1"), (1, "w5"), (1, "none"), (2, "zz"), (2, "w0")], "q_id int, token string")
    whole, some = retrieval.index(corpus), retrieval.index(corpus, asked)
    assert whole.agg(F.sum("tf")).first() == some.agg(F.sum("tf")).first()
    kept = {tuple(r) for r in some.where("token IS NOT NULL").collect()}
    assert kept == {tuple(r) for r in whole.where("token IN ('w1', 'w5', 'none', 'zz', 'w0')").collect()} and len(kept) < whole.count()
    for score in (lambda p: retrieval.bm25(asked, p, corpus), lambda p: retrieval.top_scores(asked, p, corpus, 3)):
        assert sorted(map(tuple, score(whole).collect())) == sorted(map(tuple, score(some).collect()))


def test_decisions_are_counted_in_partitions_of_bounded_size(spark):
    """Against the join of the two tables, with numbers that repeat, are unknown or null, and messages without a number."""
    numbers = [None, 0, 1, 2]
    draw = random.Random(3)
    proposals = [(m, draw.choice(numbers)) for m in (None, *range(60)) for _ in range(draw.randint(0, 3))]
    decisions = [(m, i, draw.choice(["confirm", "reject", None])) for m, i in proposals if draw.random() < 0.95]
    decisions += [(m, 3, "confirm") for m in range(5)] + [(99, 0, "confirm")]
    want = set()
    for m in range(60):
        asked = [i for k, i in proposals if k == m]
        met = [(i, d, k) for key, i, d in decisions if key == m for k in [x for x in asked if x == i and i is not None] or [None]]
        if asked and len(met) == len(asked) == len({i for i, *_ in met} - {None}) and all(k is not None for *_, k in met):
            confirmed = sum(d == "confirm" for _, d, _ in met)
            want.add((m, confirmed, confirmed == 0))
    assert want
    asked = spark.createDataFrame(proposals, "msg_id long, idx int")
    made = spark.createDataFrame(decisions, "msg_id long, idx int, decision string")
    for rows in (5, 1000):
        got = review.decide(asked, made, rows)
        assert {tuple(r) for r in got.collect()} == want
    plan = review.decide(asked, made, 5)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_orders_are_dealt_over_the_cores_of_a_cluster(spark, folder):
    from assayer.core.session import DEALT
    from assayer.sources import messages

    set_by_session = spark.conf.get("assayer.local.partitions")
    spark.conf.unset("assayer.local.partitions")
    try:
        m = messages.templated(spark, folder)
        assert m.rdd.getNumPartitions() == DEALT * spark.sparkContext.defaultParallelism
        assert m.count() == 1500 and m.select("msg_id").distinct().count() == 1500
    finally:
        spark.conf.set("assayer.local.partitions", set_by_session)
