"""Near duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint bit is 1 where more than half of a text's shingle hashes have it.
For a radius r, every bit gets one of the non-zero vectors of r + 1 bits, and
every other non-zero vector v makes a table: its mask holds the bits whose
vector has an odd product with v. Up to r differing bits leave a v that is even
with all of them, so the pair agrees under that mask: each pair within the
radius is certain to meet in one of the 2^(r+1) - 1 tables.

Equal fingerprints are one node from the start, whatever their number. A table
bucket with more than ``BUCKET`` different fingerprints is split: its free bits
fall into r + 1 blocks, and a pair within the radius agrees on one of them, so
nothing is lost; a bucket with few free bits left cannot be large. Inside a
bucket only a spanning tree of its links leaves the task.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any
other; fewer words than a shingle give one shingle of all words; rows with a
null ``doc_id`` take part, and a component of such rows only has a null id;
repeated rows stay rows; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import settle
from assayer.llm.graphs import components

BITS = 64
#: Different fingerprints of one bucket that are compared in one task.
BUCKET = 1024


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = min(shingle, len(words)) - 1
    pieces = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    total, ones = len(words) - last, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, 1 << 15):  # long texts in steps of bounded memory
        n = min(1 << 15, total - at)
        hashes = np.fromiter((digest(line[a:b], seed) for (a, b), _ in zip(pieces, range(n), strict=False)), "<u8", n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, code) of every row."""

    @F.pandas_udf("long")
    def code(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", code(F.encode("text", "UTF-8")).alias("code"))


def covering_masks(radius: int) -> list[int]:
    """The tables' masks as signed 64-bit numbers."""
    vectors = [1 + bit % (2 ** (radius + 1) - 1) for bit in range(BITS)]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << bit for bit in range(BITS) if (vectors[bit] & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _spanning(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(code, smallest code of its group inside the bucket)."""
    codes = np.sort(codes)
    left, links = np.arange(len(codes)), []
    raw = codes.view(np.uint64)
    while len(left):
        group, new = left[:1], left[:1]
        left = left[1:]
        while len(new) and len(left):
            near = (np.bitwise_count(raw[left][:, None] ^ raw[new][None, :]) <= radius).any(axis=1)
            new, left = left[near], left[~near]
            group = np.concatenate([group, new])
        links += [(int(codes[k]), int(codes[group[0]])) for k in group[1:]]
    return links


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """Spanning links of buckets that hold at most BUCKET codes each."""

    @F.pandas_udf("array<struct<node:long,to:long>>")
    def tree(groups: pd.Series) -> pd.Series:
        return pd.Series([_spanning(np.asarray(g, np.int64), radius) for g in groups])

    gathered = buckets.groupBy("path", "key").agg(F.collect_set("code").alias("codes"))
    return gathered.select(F.inline(tree("codes")))


def _split(radius: int, masks: list[int]):
    """Deal a large bucket's rows over the blocks of its free bits."""

    def blocks(path: str) -> list[int]:
        table, *steps = map(int, path.split("."))
        fixed = masks[table] & (2**BITS - 1)
        for step in [*steps, None]:
            free = [bit for bit in range(BITS) if not fixed >> bit & 1]
            parts = [sum(1 << bit for bit in free[k :: radius + 1]) | fixed for k in range(radius + 1)]
            if step is None:
                return parts
            fixed = parts[step]
        raise AssertionError

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for path, rows in batch.groupby("path"):
                if path not in known:
                    known[path] = blocks(path)
                codes = rows["code"].to_numpy(np.int64)
                for k, mask in enumerate(known[path]):
                    key = (codes.view(np.uint64) & np.uint64(mask)).view(np.int64)
                    yield pd.DataFrame({"path": f"{path}.{k}", "key": key, "code": codes})

    return deal


def links(codes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(node, to) links whose components are those of all pairs within the radius; ``codes`` are distinct."""
    masks = covering_masks(radius)
    # Codes that differ in fewer free bits than this are always few.
    if bucket < 2 ** (radius + 1):
        raise ValueError("bucket too small for the radius")
    tables = F.explode(
        F.array(*[
            F.struct(F.lit(str(t)).alias("path"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)
        ])
    )
    rows = codes.select(tables.alias("t"), "code").select("t.path", "t.key", "code")
    found: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("size")).where("size > 1")
        rows = settle(rows.join(sizes, ["path", "key"]), "simhash-buckets")
        found.append(_links(rows.where(F.col("size") <= bucket), radius))
        large = rows.where(F.col("size") > bucket)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = large.select("path", "key", "code").mapInPandas(_split(radius, masks), "path string, key long, code long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = settle(fingerprints(docs, shingle), "simhash-codes")
    codes = settle(prints.groupBy("code").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(codes.select("code"), radius, bucket), "simhash-links")
    rooted = codes.join(roots, F.col("code") == F.col("node"), "left").select(
        "code", "first", F.coalesce("root", "code").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.select("code", "root").join(smallest, "root").select("code", "component_id")
    return prints.join(labels, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )
