"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.core.session import read_table, settle, shared_dir

__all__ = ["bitmap", "documents", "in_bitmap", "let", "read_table", "scratch", "settle", "shared_dir", "words"]

#: Bits of a bitmap of hashes, a power of two: 16 MB at any size of table.
BITMAP_BITS = 1 << 27


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, also when ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words between the six ASCII white-space characters; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``settle`` into one shared folder that goes at the end; nothing read from it may be used later."""
    folder = shared_dir(spark, purpose)

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        df.write.mode("error").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    yield keep
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> Broadcast:
    """A broadcast bitmap of a table's 64-bit hashes ``h``; its size is fixed, so it may hit by chance but never misses."""
    bit = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    mask = F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))"))
    found = bit.groupBy(F.shiftright("bit", 6).alias("cell")).agg(mask.alias("bits")).toPandas()
    cells = np.zeros(bits // 64, np.int64)
    cells[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return hashes.sparkSession.sparkContext.broadcast(cells.tobytes())


def in_bitmap(shared: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit hashes may be in a bitmap."""
    cells = np.frombuffer(shared, np.uint64)
    bit = hashes & np.uint64(64 * len(cells) - 1)
    return (cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
