"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once. The top bits of the hash choose a bin, the
rest is its value, and each bin keeps its smallest. An empty bin takes the value of
a bin that is not empty, chosen by a fixed random order of its own over all bins
(optimal densification: donors are uniform and independent from bin to bin, and
alike for alike texts). Of each bin the lowest ``BITS`` bits are stored, packed.
Two different values agree in them with a chance of 2^-BITS, which ``likeness``
takes out of the share of agreeing bins.

Words stand between ASCII white space, A-Z lower-cased; fewer words than a shingle
give one shingle of all words; a text without words has an empty fingerprint, that
is like another empty one (1) and unlike any other (0). Neighbours in order of id
meet in ranges of ids: a range's first row is also sent to the range before it, so
texts are shuffled once, and no range grows with the table.

Defined cases: null is the empty text; descending order puts null ids last, and
texts under one id by a hash of the text; ids that fill a range by themselves are
split by that hash; repeated rows stay rows, each followed by the next; a single
row follows itself; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: Bins, a power of two, and the bits kept of each.
BINS, BITS = 512, 4
#: Rows of one range of ids, and the most ranges for each shuffle partition of the session.
RANGE_ROWS, RANGES_A_PARTITION = 500, 16

_STEP = 1 << 15


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, for 64-bit numbers."""
    x = numbers + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For every bin, the order in which it asks all bins for a value.
_ORDER = (_mixed(np.arange(BINS * BINS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(BINS, BINS)


def shingle_hashes(text: bytes | None, size: int = SHINGLE):
    """Hashes of all shingles, in blocks of bounded size."""
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return
    size = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, digest = len(words) - size + 1, xxhash.xxh3_64_intdigest
    for at in range(0, total, _STEP):
        upto = min(at + _STEP, total)
        places = zip(starts[at:upto].tolist(), ends[at + size - 1 : upto + size - 1].tolist(), strict=True)
        yield np.fromiter((digest(line[a:b]) for a, b in places), np.uint64, upto - at)


def bins_of(text: bytes | None) -> np.ndarray:
    """The value of each bin after densification; no bins for a text without words."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    empty = np.uint64(2**64 - 1)
    least = np.full(BINS, empty)
    for hashes in shingle_hashes(text):
        np.minimum.at(least, (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    full = np.flatnonzero(least != empty)
    if not len(full):
        return least[:0]
    vacant = np.flatnonzero(least == empty)
    least[vacant] = least[full[_ORDER[np.ix_(vacant, full)].argmin(axis=1)]]
    return least


def fingerprint(text: bytes | None) -> bytes:
    """Low-order bits of all bins, packed."""
    low = (bins_of(text) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - BITS :].ravel()).tobytes()


def likeness(left: bytes, right: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets, corrected for chance agreement and held within 0 and 1."""
    if not left or not right:
        return float(left == right)
    a, b = (np.unpackbits(np.frombuffer(x, np.uint8)).reshape(BINS, BITS) for x in (left, right))
    agreeing = float((a == b).all(axis=1).mean())
    chance = 2.0**-BITS
    return max(0.0, (agreeing - chance) / (1 - chance))


def fingerprint_of(text: Column) -> Column:
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return packed(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _compared(own: Column, edited: Column, following: Column) -> Column:
    @F.pandas_udf("struct<edited:binary,near_edited:double,near_next:double>")
    def compare(own: pd.Series, edited: pd.Series, following: pd.Series) -> pd.DataFrame:
        rows = []
        for a, text, b in zip(own, edited, following, strict=True):
            other = fingerprint(text)
            rows.append((other, likeness(a, other), likeness(a, b)))
        return pd.DataFrame(rows, columns=["edited", "near_edited", "near_next"])

    return compare(own, F.encode(edited, "UTF-8"), following)


@dataclass
class Ranges:
    """Ranges of (id, text hash) along descending ids; ``bounds`` rise, with how often each was a quantile."""

    bounds: np.ndarray
    times: np.ndarray

    def number(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers that never fall along the order. An id that is several quantiles has as many ranges of its own."""
        bounds, times = self.bounds, self.times
        at = np.searchsorted(bounds, ids, "left")
        equal = np.zeros(len(ids), bool)
        inside = at < len(bounds)
        equal[inside] = bounds[at[inside]] == ids[inside]
        # Along descending ids: the rows of a bound, then those between it and the bound below.
        hot = np.append(np.where(times > 1, times, 0), 0)
        width = hot[::-1] + 1
        first = np.concatenate([[0], np.cumsum(width)[:-1]])[::-1]
        part = ((hashes / 2.0**64 + 0.5) * hot[at]).astype(np.int64).clip(0, np.maximum(hot[at] - 1, 0))
        return first[at] + np.where(equal, part, hot[at])


def _number(doc_id: Column) -> Column:
    """The id as a number; a missing one is the smallest."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)).cast("long"))


def _ranges(docs: DataFrame, rows: int) -> Ranges | None:
    """Bounds from quantiles of the ids alone, about one for every ``rows`` rows; None of no rows.

    Their number is bounded by the session's shuffle partitions, so a table of any size sends few to the driver.
    """
    count = docs.select("doc_id").count()
    if not count:
        return None
    most = RANGES_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-count // rows), most))
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return Ranges(np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = docs.agg(F.percentile_approx(_number(F.col("doc_id")), shares, max(10_000, 4 * parts)).alias("q")).first()["q"]
    bounds, times = np.unique(np.array(found, np.int64), return_counts=True)
    return Ranges(bounds, times)


def neighbours(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): every row with the one after it, by descending id, in a ring.

    A row leaves its task once; only the first row of a range, one in about ``rows``, is sent twice.
    """
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("doc_id").isNull().alias("missing"), _number(F.col("doc_id")).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
    )
    ranges = _ranges(docs, rows) or Ranges(np.zeros(0, np.int64), np.zeros(0, np.int64))

    @F.pandas_udf("long")
    def number(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges.number(ids.to_numpy(np.int64), h.to_numpy(np.int64)))

    # The first row of every range: one per range, so as many as there are ranges.
    first = F.min(F.struct("missing", (-F.col("id").cast("decimal(20,0)")).alias("down"), "h", "id")).alias("first")
    ranged = hashed.select("missing", "id", "h", number("id", "h").alias("range"))
    heads = sorted((r["range"], r["first"]["missing"], r["first"]["id"], r["first"]["h"]) for r in ranged.groupBy("range").agg(first).collect())
    before = {tuple(head[1:]): heads[k - 1][0] for k, head in enumerate(heads)}

    @F.pandas_udf("array<long>")
    def places(missing: pd.Series, ids: pd.Series, h: pd.Series) -> pd.Series:
        """A row's own range and, of a first row, the one that it follows."""
        own = ranges.number(ids.to_numpy(np.int64), h.to_numpy(np.int64)).tolist()
        also = map(before.get, zip(missing.tolist(), ids.tolist(), h.tolist(), strict=True))
        return pd.Series([[a] if b is None else [a, b] for a, b in zip(own, also, strict=True)])

    printed = hashed.withColumns({"places": places("missing", "id", "h"), "print": fingerprint_of(F.col("text"))})
    dealt = printed.select("doc_id", "h", "text", "print", F.posexplode("places").alias("sent", "range"))
    order = Window.partitionBy("range").orderBy("sent", F.col("doc_id").desc_nulls_last(), "h")
    return (
        dealt.select(
            "doc_id", "text", "print", "sent",
            F.lead("text").over(order).alias("next_text"), F.lead("print").over(order).alias("next_print"),
        ).where("sent = 0").drop("sent")
    )


def fingerprints(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next text's are.

    The edited text is the text with its last third, in whole code points, replaced by as many of the
    first code points of the next text, or all of them. Columns: doc_id, n_chars, edited_text,
    fingerprint, edited_fingerprint (binary), near_edited, near_next.
    """
    paired = neighbours(docs, rows).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = paired.withColumn(
        "edited_text", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third))
    )
    compared = edited.withColumn("c", _compared(F.col("print"), F.col("edited_text"), F.col("next_print")))
    return compared.select(
        "doc_id", "n_chars", "edited_text", F.col("print").alias("fingerprint"), F.col("c.edited").alias("edited_fingerprint"),
        "c.near_edited", "c.near_next",
    )
