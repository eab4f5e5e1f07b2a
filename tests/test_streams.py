"""Streams over many small files give the batch answer."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayer.core.session import read_table, shared_dir
from assayer.operators import streaks
from assayer.plans.queries_aggregates import outcome_events
from assayer.plans.screening import lexicon_findings
from assayer.sources import messages
from assayer.streaming import jobs


@pytest.fixture(scope="module")
def split(spark, folder):
    """The same tables as time-ordered folders of several files."""
    root = shared_dir(spark, "test-split")
    events = read_table(spark, folder, "events").orderBy("ts")
    for i, part in enumerate(_quarters(events)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    docs = read_table(spark, folder, "documents")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    return root


def _quarters(events):
    edges = [0, 8, 15, 23, 40]
    day = F.dayofmonth("ts")
    return [events.where((day > lo) & (day <= hi)) for lo, hi in zip(edges, edges[1:])]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_client_rate(spark, folder, split):
    got = jobs.client_rate_stream(spark, split, "1 hour", 1, files_per_trigger=1)
    events = read_table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    want = jobs.client_rate(events, "1 hour").where("n > 1")
    assert rows(got, "start", "user_id", "n") == rows(want, "start", "user_id", "n")


def test_outcome_rate(spark, folder, split):
    got = jobs.outcome_rate_stream(spark, split, outcome_events, files_per_trigger=1)
    assert got.agg(F.sum("n")).first()[0] == read_table(spark, folder, "events").count()


def test_first_sight_against_brute_force(spark, folder, split):
    got = rows(jobs.first_sight(spark, split, files_per_trigger=1), "content", "event_id")
    events = read_table(spark, folder, "events").select(
        F.concat_ws(":", "user_id", "event_type").alias("c"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id"
    )
    last, want = {}, []
    for c, at, event in sorted(map(tuple, events.collect()), key=lambda r: (r[1], r[2])):
        second = at // 1_000_000
        if c not in last or second >= last[c] + 6 * 3600:
            last[c] = second
            want.append((c, event))
    assert got == sorted(want)


def test_streaks_against_brute_force(spark, folder, split):
    events = read_table(spark, folder, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "error").alias("failed")
    )
    run, want = {}, []
    for user, event, _, failed in sorted(map(tuple, events.collect()), key=lambda r: (r[2], r[1])):
        run[user] = run.get(user, 0) + 1 if failed else 0
        if failed:
            want.append((user, event, run[user], min(60 * 2 ** (run[user] - 1), 900)))
    columns = ("user_id", "event_id", "streak", "penalty")
    assert rows(streaks.failure_streaks(events), *columns) == sorted(want)
    # Coarse slices cut streaks at other places; the answer must not move.
    assert rows(streaks.failure_streaks(events, 86400 * 3), *columns) == sorted(want)
    assert rows(jobs.failure_streaks_stream(spark, split, files_per_trigger=1), *columns) == sorted(want)
    # All rows wait, or none does: the same.
    assert rows(jobs.failure_streaks_stream(spark, split, 60 * 86400, files_per_trigger=1), *columns) == sorted(want)
    assert rows(jobs.failure_streaks_stream(spark, split, 0, files_per_trigger=1), *columns) == sorted(want)


def _failure_folder(spark, *files):
    root = shared_dir(spark, "test-streaks")
    for file in files:
        _add_failures(spark, root, file)
    return root


def _add_failures(spark, root, file):
    parsed = [(i, u, "error" if failed else "view", datetime(2024, 1, 1) + timedelta(minutes=m)) for i, u, failed, m in file]
    shape = "event_id BIGINT, user_id BIGINT, event_type STRING, ts TIMESTAMP_NTZ"
    spark.createDataFrame(parsed, shape).coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")


def _streaks_of(*files):
    run, want = {}, []
    for i, u, failed, _ in sorted((e for file in files for e in file), key=lambda e: (e[3], e[0])):
        run[u] = run.get(u, 0) + 1 if failed else 0
        if failed:
            want.append((u, i, run[u]))
    return sorted(want)


def test_streaks_out_of_order(spark):
    # One user has nearly all rows; neighbouring rows change places across the files.
    drawn = random.Random(5)
    rows_ = [(i, 1 if drawn.random() < 0.9 else 2, drawn.random() < 0.8, i * 7) for i in range(400)]
    late = sorted(rows_, key=lambda e: e[3] + drawn.randrange(0, 180))
    files = [late[k : k + 60] for k in range(0, 400, 60)]
    got = jobs.failure_streaks_stream(spark, _failure_folder(spark, *files), 4 * 3600, files_per_trigger=1)
    assert rows(got, "user_id", "event_id", "streak") == _streaks_of(*files)


def test_streaks_go_on_and_late_rows_go(spark):
    name, columns = uuid.uuid4().hex, ("user_id", "event_id", "streak")
    first, second = [(1, 1, True, 0), (2, 1, True, 30), (3, 2, True, 31)], [(4, 1, True, 200), (5, 2, False, 201), (6, 2, True, 202)]
    root = _failure_folder(spark, first)
    assert rows(jobs.failure_streaks_stream(spark, root, 600, name), *columns) == _streaks_of(first)
    _add_failures(spark, root, second)
    assert rows(jobs.failure_streaks_stream(spark, root, 600, name), *columns) == _streaks_of(first, second)
    # Older than the clock of 192 minutes: it no longer counts.
    _add_failures(spark, root, [(7, 1, False, 100), (8, 1, True, 203)])
    assert rows(jobs.failure_streaks_stream(spark, root, 600, name), *columns) == _streaks_of(first, second, [(8, 1, True, 203)])
    # Nothing new: the same again.
    assert rows(jobs.failure_streaks_stream(spark, root, 600, name), *columns) == _streaks_of(first, second, [(8, 1, True, 203)])


def test_no_streaks(spark):
    assert jobs.failure_streaks_stream(spark, _failure_folder(spark, [])).count() == 0


def test_hold_and_screening(spark, folder, split):
    held = jobs.held_until_sign_in(spark, split, files_per_trigger=1)
    e = read_table(spark, folder, "events")
    a, b = e.where("event_type = 'view'").alias("a"), e.where("event_type = 'purchase'").alias("b")
    want = a.join(b, F.expr("a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 15 MINUTES")).select(
        F.col("a.user_id").alias("user_id"), F.col("a.event_id").alias("held_id"), F.col("b.event_id").alias("used_id")
    )
    assert rows(held, "user_id", "held_id", "used_id") == rows(want, "user_id", "held_id", "used_id")
    got = jobs.continuous_screening(spark, split, files_per_trigger=1)
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("msg_id"), "text")
    assert rows(got, "msg_id", "rule_id", "clause_no", "excerpt") == rows(lexicon_findings(docs), "msg_id", "rule_id", "clause_no", "excerpt")


def _documents(spark, folder):
    return read_table(spark, folder, "documents").select(F.col("doc_id").alias("msg_id"), "lang", "text")


def test_intake_goes_on_where_it_stopped(spark, folder, split, monkeypatch):
    columns = ("msg_id", "lang", "text", "n_chars", "status")
    want = rows(messages.prepared(_documents(spark, folder)), *columns)
    assert rows(jobs.intake(spark, split, files_per_trigger=1), *columns) == want

    calls, whole = [], messages.prepared

    def failing(batch):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return whole(batch)

    name = uuid.uuid4().hex
    with monkeypatch.context() as patch:
        patch.setattr(messages, "prepared", failing)
        with pytest.raises(Exception, match="lost"):
            jobs.intake(spark, split, name, files_per_trigger=1)
    assert rows(jobs.intake(spark, split, name, files_per_trigger=1), *columns) == want
    # Once more: nothing is read again, the whole output is there.
    assert rows(jobs.intake(spark, split, name, files_per_trigger=1), *columns) == want


def test_masked_before_bounded(spark):
    row = spark.createDataFrame([(1, "en", "x " * 2995 + "call 98765 43210 now"), (2, "en", "  hi  "), (3, "en", None)], "msg_id BIGINT, lang STRING, text STRING")
    got = {r.msg_id: r for r in messages.prepared(row).collect()}
    assert "98765" not in got[1].text and len(got[1].text) == 6000 and got[1].status == "too long"
    assert (got[2].text, got[2].status, got[3].text) == ("hi", "too short", None)


def test_state_expires_and_versions_part(spark):
    root = shared_dir(spark, "test-expiry")
    shape = "event_id BIGINT, user_id BIGINT, event_type STRING, ts TIMESTAMP_NTZ"

    def add(*events):
        parsed = [(i, u, "view", datetime(2024, 1, 1) + timedelta(hours=h)) for i, u, h in events]
        spark.createDataFrame(parsed, shape).coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")

    name, seen = uuid.uuid4().hex, []

    def kept(version="1", name=name):
        return [i for _, i in rows(jobs.first_sight(spark, root, version, name, seen.extend), "content", "event_id")]

    add((1, 1, 0), (2, 1, 1), (3, 2, 2))
    assert sorted(kept()) == [1, 3]
    # Started again: the state still suppresses what is within six hours.
    add((4, 1, 5), (5, 2, 9))
    assert sorted(kept()) == [1, 3, 5]
    # A day later only the newest key is left, whose own timer has not come.
    add((6, 3, 40))
    assert sorted(kept()) == [1, 3, 5, 6]
    assert seen[-1]["stateOperators"][0]["numRowsTotal"] == 1
    assert sorted(kept("2", uuid.uuid4().hex)) == [1, 3, 5, 6]
