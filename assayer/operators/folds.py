"""Logistic regression for all held-out groups at once.

Every group has its own model, trained on all rows but its own. One pass over the
rows adds up loss and gradient of many models: a row is read once, and its share is
masked out of the model of its own group. How many models share a pass is bounded by
their weights, so that neither the driver nor a task holds more with more groups.
Gradients leave a task as blocks of buckets and are summed block by block, so what reaches the driver is models x
buckets numbers, whatever the number of rows. There, every model takes its own
limited-memory quasi-Newton step; a model that has converged stands still.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of one block, steps a model remembers, and passes after which fitting ends.
BLOCK, MEMORY, PASSES = 4096, 8, 200
#: Weights of the models that are fitted together; the driver holds a few numbers for each, and sixteen in files.
TOGETHER = 1 << 20
#: Spark deletes what a query shuffled when it ends; else the files of all passes would stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows whose entries a task looks at together.
ROWS = 512
#: A model has converged when its gradient is this much smaller than at the start.
TOLERANCE = 1e-4


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("idx")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten().to_numpy(), batch.column("value").flatten().to_numpy()


def _gradient(shared, size: int):
    """(block, sums) rows: gradients of one block for all models; block -1 has losses and bias gradients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, weights, bias, balance = shared.value  # one row of weights per model
        total, edge = np.zeros((len(live), size)), np.zeros((2, len(live)))
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                offsets, idx, value = _entries(batch)
                label, fold, counts = batch.column("label").to_numpy(), batch.column("fold").to_numpy(), np.diff(offsets)
                sign, weight = np.where(label == 1, 1.0, -1.0), balance[label.astype(np.int64)]
                for at, k in enumerate(live):  # one model at a time: what is held grows with the rows' entries only
                    margin = sign * (np.add.reduceat(weights[at][idx] * value, offsets[:-1]) + bias[at])
                    share = np.where(fold == k, 0.0, weight[:, k])  # class weight over the model's rows
                    slope = -sign * share / (1 + np.exp(np.clip(margin, -700, 700)))
                    edge[0, at] += (share * np.logaddexp(0, -margin)).sum()
                    edge[1, at] += slope.sum()
                    total[at] += np.bincount(idx, np.repeat(slope, counts) * value, minlength=size)
        blocks, sums = [-1], [edge.tobytes()]
        for low in range(0, size, BLOCK):
            part = total[:, low : low + BLOCK]
            if part.any():
                blocks.append(low // BLOCK)
                sums.append(part.T.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(sums, pa.binary())], names=["block", "sums"])

    return run


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b) for b in rows["sums"])
    return pd.DataFrame({"block": [key[0]], "sums": [total.tobytes()]})


class _Steps:
    """The quasi-Newton memory of one model, as files in a folder of the driver, which are read one by one."""

    def __init__(self, folder: str):
        self.folder, self.made = folder, 0
        self.pairs: deque[str] = deque(maxlen=MEMORY)

    def direction(self, gradient: np.ndarray) -> np.ndarray:
        if not self.pairs:
            return -gradient / max(1.0, float(np.linalg.norm(gradient)))
        q, used = gradient.copy(), []
        for s, y in map(np.load, reversed(self.pairs)):
            alpha = (s @ q) / (s @ y)
            q -= alpha * y
            used.append(alpha)
        s, y = np.load(self.pairs[-1])
        q *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(map(np.load, self.pairs), reversed(used), strict=True):
            q += s * (alpha - (y @ q) / (s @ y))
        return -q

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        if s @ y > 1e-12 * (y @ y):
            path = f"{self.folder}/{self.made % MEMORY}.npy"  # takes the place of the oldest
            np.save(path, np.stack([s, y]))
            self.pairs.append(path)
            self.made += 1


def fit_held_out(rows: DataFrame, groups: list[str], sizes: dict[tuple[str, int], int], buckets: int, strength: float, passes: int = PASSES):
    """(weights, bias): one column per group, fitted on all rows of the other groups.

    ``rows`` has fold (the group's place), label, idx and value (arrays, not empty); it is read once per pass,
    so it should be a written table. ``sizes`` counts rows per group and label. Classes are balanced, the
    penalty of the weights is 1 / (2 · strength · rows), the bias has none.
    """
    count = np.array([[sum(n for (g, label), n in sizes.items() if label == y and g != own) for own in groups] for y in (0, 1)], float)
    left = count.sum(axis=0)
    classes = np.maximum((count > 0).sum(axis=0), 1)
    balance = np.where(count > 0, 1.0 / (classes * np.maximum(count, 1.0)), 0.0)
    ridge = 1.0 / (strength * np.maximum(left, 1.0))
    point, some = np.zeros((buckets + 1, len(groups))), max(1, TOGETHER // buckets)
    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        for first in range(0, len(groups), some):
            of = np.arange(first, min(first + some, len(groups)))
            with tempfile.TemporaryDirectory(prefix="steps-") as folder:
                point[:, of] = _fit_some(rows, of, balance, ridge[of], buckets, passes, folder)
    finally:
        conf.set(CLEANUP, before)
    return point[:-1], point[-1]


def _fit_some(rows: DataFrame, of: np.ndarray, balance: np.ndarray, ridge: np.ndarray, buckets: int, passes: int, folder: str) -> np.ndarray:
    """Weights and bias of the models ``of``, one column each; ``folder`` is empty and the driver's own."""
    context, models = rows.sparkSession.sparkContext, len(of)

    def evaluate(point: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses and gradients of the models ``live``; those of the others are zero."""
        shared = context.broadcast((of[live], np.ascontiguousarray(point[:-1, live].T), point[-1, live], balance))  # models x buckets
        parts = rows.mapInArrow(_gradient(shared, buckets), "block int, sums binary")
        found = parts.groupBy("block").applyInPandas(_summed, "block int, sums binary").toPandas()
        gradient = np.zeros_like(point)
        loss = np.zeros(models)
        for block, raw in zip(found["block"], found["sums"], strict=True):
            values = np.frombuffer(raw).reshape(-1, len(live))
            if block < 0:
                loss[live], gradient[-1, live] = values[0], values[1]
            else:
                gradient[block * BLOCK : block * BLOCK + len(values), live] = values
        shared.destroy()  # the driver would keep its copies, in memory and on disk, of every pass
        gradient[:-1, live] += ridge[live] * point[:-1, live]
        loss[live] += ridge[live] / 2 * (point[:-1, live] ** 2).sum(axis=0)
        return loss, gradient

    point = np.zeros((buckets + 1, models))
    loss, gradient = evaluate(point, np.arange(models))
    start = np.linalg.norm(gradient, axis=0)
    steps, length = [_Steps(tempfile.mkdtemp(dir=folder)) for _ in range(models)], np.ones(models)
    towards = np.stack([s.direction(g) for s, g in zip(steps, gradient.T, strict=True)], axis=1)
    for _ in range(passes):
        active = np.linalg.norm(gradient, axis=0) > TOLERANCE * np.maximum(start, 1e-12)
        if not active.any():
            break
        trial = point + towards * np.where(active, length, 0.0)
        tried, slope = evaluate(trial, np.flatnonzero(active))
        enough = tried <= loss + 1e-4 * length * (gradient * towards).sum(axis=0) + 1e-14
        for k in np.flatnonzero(active):
            if enough[k]:
                steps[k].learn(trial[:, k] - point[:, k], slope[:, k] - gradient[:, k])
                point[:, k], loss[k], gradient[:, k], length[k] = trial[:, k], tried[k], slope[:, k], 1.0
                towards[:, k] = steps[k].direction(gradient[:, k])
            elif length[k] > 1e-9:
                length[k] /= 2
            else:  # no progress is left in double precision
                gradient[:, k] = 0.0
    return point


def held_out_scores(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(msg_id, fold, label, score) of every row by the model that never saw its group."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, bias))  # models x buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, edge = shared.value
        for batch in batches:
            if batch.num_rows:
                offsets, idx, value = _entries(batch)
                fold = batch.column("fold").to_numpy()
                row = np.repeat(np.arange(len(fold)), np.diff(offsets))
                margin = np.add.reduceat(own[idx, fold[row]] * value, offsets[:-1]) + edge[fold]
                score = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                kept = [batch.column(c) for c in ("msg_id", "fold", "label")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=["msg_id", "fold", "label", "score"])

    kind = rows.schema["msg_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"msg_id {kind}, fold int, label double, score double")


def _merged(feats: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows``, where those of one id all have the entries of every row of ``feats`` with that id."""
    repeated = feats.groupBy("msg_id").agg(F.count("*").alias("n")).where("n > 1").select("msg_id")
    if repeated.isEmpty():
        return rows
    entries = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("idx", "value")))).alias("e")
    whole = feats.join(repeated, "msg_id").groupBy("msg_id").agg(entries)
    merged = rows.drop("idx", "value").join(whole, "msg_id").select(
        "msg_id", "fold", "label", F.transform("e", lambda x: x["idx"]).alias("idx"), F.transform("e", lambda x: x["value"]).alias("value")
    )
    return rows.join(repeated, "msg_id", "left_anti").unionByName(merged)


def training_table(feats: DataFrame, labels: DataFrame, groups: list[str]) -> DataFrame:
    """(msg_id, fold, label, idx, value) of every labelled message with features.

    Rows with their features, source and label in them are not shuffled.
    """
    order = F.array(*[F.lit(g) for g in groups])
    fold = (F.array_position(order, F.col("source")) - 1).cast("int").alias("fold")
    if "label" in feats.columns:
        known = feats.where("source IS NOT NULL AND label IS NOT NULL")
        return _merged(feats, known.select("msg_id", fold, F.col("label").cast("double").alias("label"), "idx", "value"))
    entries = F.array_sort(F.collect_list(F.struct("idx", "value")))
    whole = feats.groupBy("msg_id").agg(entries.alias("e")).join(labels, "msg_id")
    return whole.select(
        "msg_id", fold, F.col("label").cast("double").alias("label"),
        F.transform("e", lambda x: x["idx"]).alias("idx"), F.transform("e", lambda x: x["value"]).alias("value"),
    )
