"""Embedding whitening by slicing the spectrum of the covariance.

A shifted covariance V - sI is factored as L D Lᵀ; by Sylvester's law the signs of
D count the eigenvalues above s. Bisection on these counts isolates the i-th
eigenvalue, Rayleigh quotient iteration then converges cubically to its vector,
and two more counts, just above and just below, certify that it is the i-th.

Entries are put on a grid of 1/256 first, and equal grid vectors count once. Sums
are exact integers; the covariance is centred before it is multiplied. Spark adds
up one small matrix per task, cell by cell; only dimensions x dimensions numbers
reach the driver, whatever the number of rows.

Defined cases: a vector that is null, empty, or holds a null, a NaN or an infinity
is dropped, and so is one whose length is not the most frequent (the longer of a
tie); grid values past 64 bits saturate; a null ``vec_id`` is kept; repeated rows
stay rows; further columns are ignored. Directions without variance are no
components, so equal vectors, a single vector and an empty table give no rows.
Eigenvalues that double precision cannot tell apart get orthogonal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import settle

#: Grid steps per unit.
STEPS = 256
COMPONENTS = 4
#: Bunch and Parlett's bound between single and double pivots.
_PIVOT = (1 + 17**0.5) / 8


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than ``shift``, by the inertia of L D Lᵀ."""
    left = np.array(matrix, np.float64) - shift * np.eye(len(matrix))
    above = 0
    while (size := len(left)) > 0:
        magnitude = np.abs(left)
        diagonal = magnitude.diagonal()
        single = int(diagonal.argmax())
        off = magnitude - np.diag(diagonal)
        a, b = divmod(int(off.argmax()), size)
        if off[a, b] == 0 and diagonal[single] == 0:
            return above  # what is left is zero
        if diagonal[single] >= _PIVOT * off[a, b]:
            chosen = [single]
            above += int(left[single, single] > 0)
        else:  # a double pivot has one eigenvalue of each sign
            chosen = [a, b]
            above += 1
        rest = np.delete(np.arange(size), chosen)
        column, pivot = left[np.ix_(rest, chosen)], left[np.ix_(chosen, chosen)]
        left = left[np.ix_(rest, rest)] - column @ np.linalg.solve(pivot, column.T)
        left = (left + left.T) / 2
    return above


def _rayleigh(matrix: np.ndarray, start: np.ndarray, shift: float, found: list[np.ndarray], scale: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration, kept orthogonal to the vectors already found."""

    def free(vector: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for known in found:
                vector = vector - known * (known @ vector)
        return vector / np.linalg.norm(vector)

    vector, quotient, identity = free(start), shift, np.eye(len(matrix))
    for step in range(60):
        try:
            moved = np.linalg.solve(matrix - quotient * identity, vector)
        except np.linalg.LinAlgError:
            moved = np.linalg.solve(matrix - (quotient + 1e-15 * scale) * identity, vector)
        if not np.all(np.isfinite(moved)):
            break
        vector = free(moved / np.abs(moved).max())
        now = float(vector @ matrix @ vector)
        settled = np.linalg.norm(matrix @ vector - now * vector) <= 4e-15 * scale
        # The first steps keep the isolating shift, so that the iteration cannot leave for a neighbour.
        quotient = now if step >= 2 else quotient
        if settled and step >= 3:
            break
    return float(vector @ matrix @ vector), vector


def leading(matrix: np.ndarray, wanted: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The largest eigenvalues with unit vectors, falling; those that are zero in double precision are left out."""
    size = len(matrix)
    trace = float(np.trace(matrix))
    if not size or trace <= 0:
        return []
    radius = float(np.abs(matrix).sum(axis=1).max())
    least = 8 * size * np.finfo(float).eps * radius
    found: list[tuple[float, np.ndarray]] = []
    draw = np.random.default_rng(13)
    for nth in range(1, min(wanted, size, eigenvalues_above(matrix, least)) + 1):
        low, high = least, 1.01 * radius  # more than nth - 1 eigenvalues lie above low, fewer than nth above high
        above_low, above_high = size, 0
        while True:
            middle = (low + high) / 2
            apart = middle not in (low, high) and high - low > 1e-14 * radius
            if above_low == nth and above_high == nth - 1 or not apart:
                value, vector = _rayleigh(matrix, draw.standard_normal(size), middle, [v for _, v in found], radius)
                # The counts on both sides certify the number; a cluster narrower than rounding counts as one.
                slack = max(1e-13 * radius, 1e-12 * value)
                if not apart or (
                    low - slack <= value <= high + slack
                    and eigenvalues_above(matrix, value + slack) <= nth - 1
                    and eigenvalues_above(matrix, value - slack) >= nth
                ):
                    found.append((value, vector))
                    break
            count = eigenvalues_above(matrix, middle)
            if count >= nth:
                low, above_low = middle, count
            else:
                high, above_high = middle, count
    return found


def gridded(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector, and ``x``, its entries in whole grid steps."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    usable = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    return usable.select("vec_id", F.transform(v, lambda c: F.floor(c.cast("double") * STEPS).cast("long")).alias("x"))


def _scatter(size: int, n: int, sums: list[int]):
    """One task's share of the sum of (x - S/n)(x - S/n)ᵀ, upper half, by cell."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((size, size)), np.array(sums, np.float64) / n
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            centred = x - mean
            total += centred.T @ centred
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    return share


@dataclass
class Whitening:
    """What the fit list gives: its size, sums per dimension, trace, and the components."""

    n: int
    sums: list[int]
    trace: float
    values: list[float]
    vectors: list[list[float]]

    def project(self, x: Column) -> Column:
        """``x`` centred, on each component, over the root of its eigenvalue: an array of doubles."""
        scaled = np.array(self.vectors).reshape(len(self.values), -1) / np.sqrt(np.array(self.values))[:, None]
        mean = np.array(self.sums, np.float64) / self.n

        @F.arrow_udf("array<double>")
        def projected(rows: pa.Array) -> pa.Array:
            flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            out = (flat - mean) @ scaled.T
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

        return projected(x)

    def deviation(self, x: Column) -> Column:
        """The sum over dimensions of (n*x - S)^2, exact, as a decimal of 38 digits."""
        wide = "decimal(38,0)"
        sums = F.array(*[F.lit(str(s)).cast(wide) for s in self.sums])
        square = F.zip_with(x, sums, lambda c, s: F.try_multiply(
            (c.cast("decimal(19,0)") * F.lit(self.n).cast("decimal(18,0)")).cast(wide) - s,
            (c.cast("decimal(19,0)") * F.lit(self.n).cast("decimal(18,0)")).cast(wide) - s,
        ).cast(wide))
        return F.aggregate(square, F.lit(0).cast(wide), lambda a, b: F.try_add(a, b).cast(wide))


def fit(points: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Sums, covariance and components of distinct ``x``; None of no rows."""
    sums = [F.sum(F.col("x")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(size)]
    totals = points.agg(F.count("*").alias("n"), *sums).first()
    if not totals["n"]:
        return None
    n, whole = totals["n"], [int(totals[f"s{k}"]) for k in range(size)]
    cells = points.mapInArrow(_scatter(size, n, whole), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    matrix = np.zeros((size, size))
    for cell in cells.collect():
        matrix[cell.i, cell.j] = matrix[cell.j, cell.i] = cell.v / n
    found = leading(matrix, components)
    return Whitening(n, whole, float(np.trace(matrix)), [e for e, _ in found], [v.tolist() for _, v in found])


def _identity_error(points: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the measured covariance of the projected fit list minus the identity."""
    count = len(fitted.values)
    projected = points.select(fitted.project(F.col("x")).alias("w")).select(*[F.col("w")[k].alias(f"w{k}") for k in range(count)])
    means = projected.agg(*[F.avg(f"w{k}") for k in range(count)]).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    centred = projected.agg(*[F.sum((F.col(f"w{i}") - means[i]) * (F.col(f"w{j}") - means[j])) for i, j in pairs]).first()
    return max(abs(total / fitted.n - (i == j)) for (i, j), total in zip(pairs, centred, strict=True))


_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    rows = settle(gridded(vectors, vector), "whitening-grid")
    lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "size")).alias("most")).first()["most"]
    spark = vectors.sparkSession
    if usual is None:
        return spark.createDataFrame([], _RESULT)
    rows = rows.where(F.size("x") == usual["size"])
    points = settle(rows.select("x").distinct(), "whitening-points")
    fitted = fit(points, usual["size"], components)
    if fitted is None or not fitted.values:
        return spark.createDataFrame([], _RESULT)
    error = _identity_error(points, fitted)
    explained = F.array(*[F.lit(e / fitted.trace) for e in fitted.values])
    each = rows.select("vec_id", fitted.deviation(F.col("x")).alias("deviation"), F.posexplode(fitted.project(F.col("x"))).alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
