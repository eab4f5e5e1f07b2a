from pyspark.sql import functions as F

from assayer.operators import model
from assayer.plans.catalog import queries


def test_training_learns_and_prunes(spark):
    rows = [(i, ("pay the fee now " if i % 2 else "the meeting is on monday ") + str(i % 7), f"s{i % 3}", float(i % 2)) for i in range(60)]
    m = spark.createDataFrame(rows, "msg_id BIGINT, text STRING, source STRING, label DOUBLE")
    feats = model.features(m.select("msg_id", "text"), "w b c", 4096)
    norms = feats.groupBy("msg_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)
    fitted = model.fit(model.training_rows(feats, m.select("msg_id", "source", "label"), 4096), 20)
    weights, bias = model.pruned(spark, fitted, 50)
    assert weights.count() == 50
    scored = model.score(feats, weights, bias).join(m, "msg_id")
    assert scored.where((F.col("score") >= 0.5) != (F.col("label") == 1)).count() == 0


def test_perturbed_messages_keep_their_findings(spark, folder):
    for r in queries()["dq7_metamorphic_messages"](spark, folder).collect():
        assert r.n_changed == 0, r


def test_scores_agree(spark, folder):
    row = queries()["mdl9_score_parity"](spark, folder).first()
    assert row.n_checked == 1500 and row.n_apart == 0


def test_models_of_all_held_out_sources_at_once(spark):
    import numpy as np

    from assayer.operators import model

    rng = np.random.default_rng(4)
    texts, labels = [], []
    for k in range(90):
        bad = k % 3 == 0
        words = [f"w{rng.integers(0, 40)}" for _ in range(12)] + ["lottery"] * int(bad and k % 4 > 0) + ["tea"] * int(not bad and k % 5 > 0)
        texts.append((k, " ".join(words)))
        labels.append((k, f"s{k % 4}", float(bad)))
    feats = model.features(spark.createDataFrame(texts, "msg_id long, text string"), "w b", 512)
    marked = spark.createDataFrame(labels, "msg_id long, source string, label double")
    together = sorted((r.source, r.risky, r.score) for r in model.leave_one_source_out(feats, marked, 512).collect())
    rows = model.training_rows(feats, marked, 512).cache()
    alone = []
    for source in ("s0", "s1", "s2", "s3"):
        fitted = model.fit(rows.where(f"source <> '{source}'"), 300)
        scored = fitted.transform(rows.where(f"source = '{source}'"))
        alone += [(r.source, r.label == 1, float(r.probability[1])) for r in scored.collect()]
    alone.sort()
    assert [x[:2] for x in together] == [x[:2] for x in alone]
    assert max(abs(a[2] - b[2]) for a, b in zip(together, alone)) < 1e-3


def test_the_independent_scorer_hashes_a_place_once(monkeypatch):
    import pyarrow as pa

    from assayer.plans import queries_model

    seen, place_features = [], queries_model.place_features
    monkeypatch.setattr(queries_model, "place_features", lambda *place: seen.append(place[:1]) or place_features(*place))
    scores = queries_model._score_alone.func(pa.array(["pay now pay now", "pay now"])).to_pylist()
    assert len(scores) == 2 and len(seen) == 3


def test_features_listed_in_the_row_are_those_of_the_rows_apart(spark):
    texts = [(1, "pay the fee now, pay now", "a", 1.0), (2, "", "a", 0.0), (3, "tea on monday", "b", 0.0)]
    m = spark.createDataFrame(texts, "msg_id long, text string, source string, label double")
    listed = model.listed_features(m, "w b c k kb s", 512)
    assert listed.columns == ["msg_id", "source", "label", "idx", "value"]
    assert "Exchange" not in listed._jdf.queryExecution().executedPlan().toString()
    each = listed.select("msg_id", F.explode(F.arrays_zip("idx", "value")).alias("e")).select("msg_id", "e.*")
    apart = model.features(m.select("msg_id", "text"), "w b c k kb s", 512)
    assert sorted(each.collect()) == sorted(apart.collect()) and each.count() > 20
    vectors = {r.msg_id: r.features for r in model.settled_vectors(listed, 512).collect()}
    assert vectors[3].size == 512 and list(vectors[3].indices) == listed.where("msg_id = 3").first().idx


def test_listed_features_of_repeated_ids_train_like_rows_apart(spark):
    rows = [(k % 25, ("lottery " if k % 3 else "tea ") + f"w{k % 25 % 7} w{k % 25 % 5}", f"s{k % 25 % 2}", float(k % 25 % 3 > 0)) for k in range(30)]
    m = spark.createDataFrame(rows, "msg_id long, text string, source string, label double")
    marked = m.select("msg_id", "source", "label")
    one = model.leave_one_source_out(model.features(m.select("msg_id", "text"), "w", 64), marked, 64, 5).collect()
    two = model.leave_one_source_out(model.listed_features(m, "w", 64), marked, 64, 5).collect()
    assert len(one) == 30 and sorted((r.source, r.risky, round(r.score, 9)) for r in one) == sorted((r.source, r.risky, round(r.score, 9)) for r in two)


def test_features_are_those_of_the_places_by_definition():
    import numpy as np
    import pyarrow as pa

    from assayer.functions import hashing

    rows = [["pay", "pay", "ﬁ", "₹", "भेजो", "chhoota", "😀x", "aa"], [], None, ["a"], ["x" * 300, "টাকা", "pay", "pay"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(rows, pa.list_(pa.string()))], names=["id", "tokens"])
    for kinds in (hashing.ALL_KINDS, "w", "b", "s kb"):
        found = pa.Table.from_batches(list(hashing.feature_lists(kinds, 2**18)(iter([batch])))).to_pylist()
        told = {r["id"]: dict(zip(r["idx"], r["value"])) for r in found}
        for at, tokens in enumerate(rows):
            names = [
                f for a, b in zip(tokens or [], [*(tokens or [])[1:], None])
                for f in hashing.place_features(a, hashing.sound(a), b, None if b is None else hashing.sound(b), kinds.split())
            ]
            idx, n = np.unique([int(h) % 2**18 for h in hashing.fnv1a(names)], return_counts=True)
            value = 1 + np.log(n)
            assert told.get(at, {}) == dict(zip(idx.tolist(), (value / np.sqrt((value * value).sum())).tolist())), (kinds, at)


def test_what_a_part_holds_is_bounded_by_its_tokens():
    import pyarrow as pa

    from assayer.functions import hashing

    rows = [[f"w{k}x{i}" for i in range(400)] for k in range(300)] + [[f"y{i}" for i in range(40_000)], ["z"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["id", "tokens"])
    seen = []
    for part, *_ in hashing._scaled("w b", 4096, iter([batch])):
        sizes = [len(r) for r in part.column("tokens").to_pylist()]
        assert sum(sizes) <= 32_768 or len(sizes) == 1
        seen += part.column("id").to_pylist()
    assert seen == list(range(len(rows)))


def test_wide_rows_are_read_in_row_groups_of_bounded_size(spark):
    import pyarrow.parquet as pq

    from assayer.operators.model import listed_features, settled_vectors

    m = spark.range(0, 1200, 1, 1).select(
        F.col("id").alias("msg_id"), F.lit("s").alias("source"), F.lit(1.0).alias("label"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.md5((i * 7919 + F.col("id")).cast("string"))), " ").alias("text"),
    )
    written = settled_vectors(listed_features(m, "w c", 2**18), 2**18)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written.inputFiles()]
    groups = [f.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 1200 and max(g.num_rows for g in groups) < 600


def test_scores_made_in_the_row_are_those_of_the_features_apart(spark):
    rows = [(k % 40, f"pay fee {k} now " + "tea " * (k % 3) + "भेजो") for k in range(60)] + [(99, ""), (100, "₹ 5% @x")]
    m = spark.createDataFrame(rows, "msg_id long, text string")
    weights = spark.range(0, 512, 3).select(F.col("id").cast("int").alias("idx"), (F.col("id") % 7 - 3).cast("double").alias("w"))
    apart = {r.msg_id: r.score for r in model.score(model.features(m, "w b c k kb s", 512), weights, 0.25).collect()}
    whole = model.scored(m, weights, 0.25, "w b c k kb s", 512)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Explode" not in plan
    found = {r.msg_id: r.score for r in whole.collect()}
    assert found.keys() == apart.keys() and len(found) == 41 and max(abs(found[k] - apart[k]) for k in found) < 1e-12


def test_no_feature_leaves_its_row_where_messages_are_scored(spark, folder):
    plan = queries()["mdl7_batch_score"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "idx" not in plan


def test_the_independent_scorer_follows_the_definition():
    import math

    import pyarrow as pa

    from assayer.functions import hashing
    from assayer.plans import queries_model

    text = "pay pay pay the fee now, pay भेजो"
    tokens = "pay pay pay the fee now pay भेजो".split()
    names = [
        f for a, b in zip(tokens, [*tokens[1:], None])
        for f in hashing.place_features(a, hashing.sound(a), b, b and hashing.sound(b), hashing.ALL_KINDS.split())
    ]
    buckets = [int(h) % hashing.BUCKETS for h in hashing.fnv1a(names)]
    values = {i: 1 + math.log(buckets.count(i)) for i in buckets}
    norm = math.sqrt(sum(v * v for v in values.values()))
    total = sum((i * 7919 % 2001 - 1000) / 500 * v / norm for i, v in values.items())
    got = queries_model._score_alone.func(pa.array([text])).to_pylist()
    assert abs(got[0] - 1 / (1 + math.exp(-(model.FROZEN_BIAS + total)))) < 1e-12


def test_models_that_do_not_fit_together_are_fitted_one_after_another(spark, monkeypatch):
    from assayer.operators import folds

    rows = [(k, ("lottery " if k % 3 else "tea ") + f"w{k % 7} w{k % 5}", f"s{k % 5}", float(k % 3 > 0)) for k in range(40)]
    m = spark.createDataFrame(rows, "msg_id long, text string, source string, label double")
    listed = model.listed_features(m, "w", 64)
    seen, gradient = [], folds._gradient

    def noted(shared, size):
        seen.append(len(shared.value[0]))
        return gradient(shared, size)

    monkeypatch.setattr(folds, "_gradient", noted)
    together = model.leave_one_source_out(listed, m, 64, 6).collect()
    assert max(seen) == 5
    seen.clear()
    monkeypatch.setattr(folds, "TOGETHER", 128)
    apart = model.leave_one_source_out(listed, m, 64, 6).collect()
    assert max(seen) == 2 and len(apart) == 40
    assert sorted((r.source, r.risky, round(r.score, 9)) for r in apart) == sorted((r.source, r.risky, round(r.score, 9)) for r in together)
