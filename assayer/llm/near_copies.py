"""Near copies by SimHash, and by the Jaccard similarity of word shingles.

Candidates come from two searches. SimHash with covering masks is certain to find
all texts whose fingerprints differ in at most ``RADIUS`` bits. Texts at the bound
differ in more, so MinHash bands add those: such a pair shares none of the 20
bands of four hashes with a chance of 0.00003, a closer pair with less. Every
candidate whose sketches agree is then compared exactly, on its whole set of shingles.

Equal sets are one node from the start. In a band's bucket of up to ``BUCKET``
nodes all pairs are compared. In a larger one all are compared with its smallest
node first; whatever that does not join meets the whole bucket, so nothing is lost
and one large group of close copies costs a line, not a square. They meet in blocks:
a task counts the shingles that the sets of two blocks share, and only links that
join what is still apart leave it, so no row is made for a pair.

Words stand between ASCII white space, A-Z lower-cased; fewer words than a
shingle give one shingle of all words.

Defined cases: null, empty and blank texts are one group; a ``doc_id`` of any type,
null too, is passed on as it is; repeated rows are one group; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import simhash
from assayer.llm.common import bitmap, in_bitmap, scratch, settle
from assayer.llm.graphs import components

SHINGLE, SIMILAR = 5, 0.8
#: Bits in which SimHash fingerprints of near copies may differ.
RADIUS = 3
BANDS, ROWS = 20, 4
#: Nodes of one bucket of which all pairs are compared at once.
BUCKET = 64
#: Nodes, and shingles, of a large bucket's block on average; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_DRAWN = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + size])) for k in range(len(words) - size + 1)), np.uint64))


def _signed(number: int) -> int:
    return number - 2**63


def _least(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1 << 10):  # long texts in steps of bounded memory
        x = (found[at : at + (1 << 10), None] ^ _DRAWN[0]) * (_DRAWN[1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * (_DRAWN[1] | np.uint64(1))).min(axis=0))
    return least


#: Texts that a task holds as Python objects at a time.
_TEXTS = 256


def _by_text(rows: DataFrame, one, schema: str, wanted: Broadcast | None = None) -> DataFrame:
    """``one`` over the text of rows (row_id, ..., text), few texts at a time; it gives the columns after the others.

    With ``wanted``, a bitmap, only for rows whose number may be in it: texts are read where they are, not shuffled.
    """
    fields = [n.split() for n in schema.split(",")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[kind] for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column("row_id").to_numpy().view(np.uint64))))
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                found = [one(t) for t in part.column("text").to_pylist()]
                made = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + made, names=batch.schema.names[:-1] + [n for n, _ in fields])

    before = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.withColumn("text", F.encode("text", "UTF-8")).mapInArrow(run, f"{before}, {schema}")


def _sketch(text: bytes | None) -> tuple[int, int, bytes, list[int]]:
    """(node, size, low bits of the MinHash values, bands): a set's own hash, its size and its sketch."""
    found = shingles(text)
    node = _signed(xxhash.xxh64_intdigest(found.tobytes()))
    if not len(found):
        return node, 0, b"", []
    least = _least(found)
    rows = least.reshape(BANDS, ROWS)
    bands = [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(rows)]
    return node, len(found), least.astype(np.uint16).tobytes(), bands


def _set(text: bytes | None) -> tuple[np.ndarray]:
    return (shingles(text).view(np.int64),)


def _likely(left: Column, right: Column) -> Column:
    """Whether two sketches agree often enough. At the bound 64 of 80 values agree on average; below 40 do not once in 10^9 pairs."""

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        both = [np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (a, b)]
        return pd.Series((both[0] == both[1]).sum(axis=1) >= BANDS * ROWS / 2) if len(a) else pd.Series([], dtype=bool)

    return likely(left, right)


def _pairs(left: DataFrame, right: DataFrame, where: str) -> DataFrame:
    """(node, to) of one bucket, to < node, whose sizes allow the similarity."""
    a, b = left.alias("a"), right.alias("b")
    fits = f"least(a.size, b.size) >= {SIMILAR} * greatest(a.size, b.size)"
    met = a.join(b, "key").where(f"a.node <> b.node AND {fits} AND ({where})")
    return met.select(F.greatest("a.node", "b.node").alias("node"), F.least("a.node", "b.node").alias("to"))


def _by_fingerprint(nodes: DataFrame, rows: DataFrame, keep) -> DataFrame:
    """(node, to) of nodes that SimHash links, to < node, whose sizes allow the similarity: a line to the smallest node of
    every fingerprint, and between the smallest nodes of linked fingerprints."""
    codes = simhash.fingerprints(rows.select(F.col("row_id").alias("doc_id"), "text"), SHINGLE).dropDuplicates(["doc_id"])
    coded = nodes.where("size > 0").select("row_id", "node", "size").join(codes.withColumnRenamed("doc_id", "row_id"), "row_id")
    coded = keep(coded.select("code", "node", "size"), "codes")
    firsts = keep(coded.groupBy("code").agg(F.min(F.struct("node", "size")).alias("first")), "code-firsts")
    same = coded.join(firsts, "code").select("node", "size", "first")
    near = simhash.links(firsts.select("code"), RADIUS)
    ends = near.join(firsts.select(F.col("code").alias("node"), F.col("first").alias("one")), "node")
    near = ends.join(firsts.select(F.col("code").alias("to"), "first"), "to").select("one.node", "one.size", "first")
    fits = f"node <> first.node AND least(size, first.size) >= {SIMILAR} * greatest(size, first.size)"
    found = same.unionByName(near).where(fits)
    return found.select(F.greatest("node", "first.node").alias("node"), F.least("node", "first.node").alias("to"))


def _sets(asked: DataFrame, nodes: DataFrame, rows: DataFrame, keep, name: str) -> DataFrame:
    """(node, found) with the whole sets of the nodes in ``asked``."""
    chosen = keep(nodes.join(asked.distinct(), "node").select("node", "row_id"), f"{name}-chosen")
    wanted = bitmap(chosen.select(F.col("row_id").alias("h")))
    found = _by_text(rows.select("row_id", "text"), _set, "found array<long>", wanted).dropDuplicates(["row_id"])
    return keep(found.join(chosen, "row_id").select("node", "found"), f"{name}-sets")


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, keep, name: str) -> DataFrame:
    """The pairs at or above the similarity: by their sketches first, then on their whole sets."""
    prints = nodes.select("node", "low")
    met = pairs.distinct().join(prints, "node").join(prints.select(F.col("node").alias("to"), F.col("low").alias("low_to")), "to")
    pairs = keep(met.where(_likely(F.col("low"), F.col("low_to"))).select("node", "to"), f"{name}-pairs")
    sets = _sets(pairs.select("node").unionByName(pairs.select(F.col("to").alias("node"))), nodes, rows, keep, name)
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("to"), F.col("found").alias("other")), "to")
    shared = both.select("node", "to", F.size(F.array_intersect("found", "other")).alias("n"), (F.size("found") + F.size("other")).alias("total"))
    return keep(shared.where(F.col("n") >= SIMILAR * (F.col("total") - F.col("n"))).select("node", "to"), f"{name}-links")


def _joining(part: np.ndarray, root: np.ndarray, found: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Places of similar sets that join everything apart that similar sets join, across two parts or inside the only one."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begin = np.cumsum(sizes) - sizes
    _, code, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(found)), sizes)[np.argsort(code, kind="stable")]
    first = np.cumsum(times) - times
    across = part.min() < part.max()
    _, label = np.unique(root, return_inverse=True)
    # Of two sets that are apart, one at least is not in the largest group.
    for x in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        mine = code[begin[x] : begin[x] + sizes[x]]
        n = times[mine]
        shared = np.bincount(holders[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(found))
        near = (shared >= SIMILAR * (sizes[x] + sizes - shared)) & (label != label[x])
        for y in np.flatnonzero(near & (part != part[x]) if across else near).tolist():
            if label[y] != label[x]:
                yield x, y
                label[label == label[y]] = label[x]


def _by_blocks(large: DataFrame, roots: DataFrame, nodes: DataFrame, rows: DataFrame, keep) -> DataFrame:
    """(node, to) links that join what is apart in large buckets: nodes that the bucket's smallest did not join meet all others.

    Either side of a bucket is dealt over blocks; a pair of blocks is one task, unless both are of the smallest node's side.
    """
    rooted = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pivots = rooted.where("node = pivot").select("key", F.col("root").alias("pivot_root"))
    rooted = rooted.join(pivots, "key").select("key", "node", "size", "root", F.expr("root <> pivot_root").alias("apart"))
    rooted = keep(rooted, "rooted")

    def blocks(side: Column) -> Column:
        weight = F.sum(F.when(side, F.col("size")).otherwise(0))
        return F.ceil(F.greatest(F.count_if(side) / BLOCK, weight / BLOCK_SHINGLES)).cast("int")

    sides = rooted.groupBy("key").agg(blocks(~F.col("apart")).alias("joined"), blocks(F.col("apart")).alias("others")).where("others > 0")
    part = F.expr("CAST(IF(apart, joined + pmod(xxhash64(node), others), pmod(xxhash64(node), joined)) AS INT)")
    dealt = keep(rooted.join(sides, "key").withColumn("part", part), "dealt")
    sets = _sets(dealt.select("node"), nodes, rows, keep, "second")
    met = dealt.withColumn("other", F.explode(F.expr("sequence(IF(apart, 0, joined), joined + others - 1)"))).join(sets, "node")

    def join(meeting: pd.DataFrame) -> pd.DataFrame:
        node = meeting["node"].to_numpy(np.int64)
        links = [sorted((int(node[x]), int(node[y]))) for x, y in _joining(meeting["part"].to_numpy(), meeting["root"].to_numpy(), list(meeting["found"]))]
        return pd.DataFrame({"node": [b for _, b in links], "to": [a for a, _ in links]}, dtype="int64")

    met = met.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "node", "root", "part", "found")
    return keep(met.groupBy("key", "a", "b").applyInPandas(join, "node long, to long").distinct(), "second-links")


def near_copies(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(row_id, doc_id, component) of every row; rows with one ``row_id``, a number, have one text."""
    with scratch(rows.sparkSession, "near-copies") as keep:
        return settle(_near_copies(rows.select("row_id", "doc_id", "text"), bucket, keep), "near-copy-groups")


def _near_copies(rows: DataFrame, bucket: int, keep) -> DataFrame:
    prints = keep(_by_text(rows, _sketch, "node long,size long,low binary,bands array<long>"), "prints")
    nodes = prints.groupBy("node").agg(F.min("row_id").alias("row_id"))
    nodes = keep(prints.drop("doc_id").join(nodes.select("row_id"), "row_id", "left_semi").dropDuplicates(["node"]), "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "size")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    met = keep(keyed.join(shared, "key"), "buckets")
    small, large = met.where(F.col("n") <= bucket), met.where(F.col("n") > bucket)
    fits = large.join(large.where("node = pivot").select("key", F.col("size").alias("pivot_size")), "key")
    stars = fits.where(f"node <> pivot AND least(size, pivot_size) >= {SIMILAR} * greatest(size, pivot_size)")
    pairs = _pairs(small, small, "a.node > b.node").unionByName(stars.select("node", F.col("pivot").alias("to")))
    pairs = pairs.unionByName(_by_fingerprint(nodes, rows, keep))
    links = _alike(pairs, nodes, rows, keep, "first")
    roots = components(links, "near-copy-roots")
    if not large.isEmpty():
        links = links.unionByName(_by_blocks(large, roots, nodes, rows, keep))
        roots = components(links, "near-copy-roots")
    return prints.join(roots, "node", "left").select(
        "row_id", "doc_id", F.coalesce("root", "node").alias("component")
    )
