"""Substring dedup by super-k-mers.

A window is ``window`` consecutive words of one document. Each window has a
minimiser, the smallest hash of its three-word sub-windows; consecutive windows
with one minimiser travel together, as one packed string, to the bucket of that
minimiser. All occurrences of a window meet there. A bucket sorts its windows by
content, compares neighbours word by word and keeps the earliest of each.

Packed strings are merged within a task before they travel, compressed, many to
a row. Buckets are sized from the corpus, and their loads are counted first: the
windows of a bucket that would be too heavy (a passage that very many documents
share) are not packed but leave by content digest, one row per window, to an
aggregate that combines in every task and a join that can split a hot key.

"Earlier" means a smaller ``doc_id``, then a smaller start. Defined cases: a null
``doc_id`` is smaller than any other; rows with one ``doc_id`` and one text are the
same document and get the same result; with one ``doc_id`` and different texts
they are different documents, ordered by a hash of the text; null texts have no
words; an empty table gives an empty result; further columns are kept, but for those
named like a result and names that begin with an underscore.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SUB = 20, 3
#: Text that a task packs at a time, and packed text that a bucket should get, in bytes.
FLUSH, BUCKET = 3 << 20, 6 << 20
#: Times the wanted load from which a bucket's windows leave one by one.
HEAVY = 4

_OCCURRENCE = np.dtype([("packed", "<i4"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i4")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out, done = np.minimum(out[: len(out) - step], out[step:]), done + step
    return out


class Flush:
    """Documents that a task holds at a time, cut into runs of windows with one minimiser."""

    def __init__(self, docs: list[tuple[int, int, list[bytes]]], window: int):
        self.docs = docs
        words = [word for _, _, own in docs for word in own]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.line = b" ".join(words)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        counts = np.array([len(own) for _, _, own in docs], np.int64)
        self.first = np.cumsum(counts) - counts
        doc_of = np.repeat(np.arange(len(docs)), counts)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        sub = hashes[: len(hashes) - SUB + 1].copy()
        for k in range(1, SUB):
            sub = mix(sub) + hashes[k : len(hashes) - SUB + 1 + k]
        low = sliding_min(mix(sub), window - SUB + 1)
        inside = doc_of[: len(low)] == doc_of[window - 1 :]
        change = np.flatnonzero((low[1:] != low[:-1]) | (doc_of[1 : len(low)] != doc_of[: len(low) - 1])) + 1
        begin = np.concatenate([[0], change])
        # Windows that reach into the next document stand at the end of a document's stretch.
        reach = np.cumsum(np.concatenate([[0], inside]))
        length = reach[np.concatenate([change, [len(low)]])] - reach[begin]
        some = length > 0
        self.begin, self.length = begin[some], length[some]
        self.minimiser, self.doc = low[self.begin], doc_of[self.begin]

    def buckets(self, number: int) -> np.ndarray:
        return (self.minimiser % np.uint64(number)).astype(np.int64)

    def packed(self, window: int) -> list[bytes]:
        cuts = zip(
            self.starts[self.begin].tolist(), self.ends[self.begin + self.length + window - 2].tolist(), strict=True
        )
        return [self.line[a:b] for a, b in cuts]


def _flushes(batches: Iterator[pd.DataFrame], window: int, size: int = FLUSH) -> Iterator[Flush]:
    held, weight = [], 0
    for batch in batches:
        for doc, key, text in zip(batch["doc"], batch["key"], batch["text"], strict=True):
            words = text.split() if text else []
            if len(words) < window:
                continue
            held.append((doc, key, words))
            weight += len(text)
            if weight >= size:
                yield Flush(held, window)
                held, weight = [], 0
    if held:
        yield Flush(held, window)


def merge(strings: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """Different strings numbered in order, and the number of each."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    number = np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))
    return dict(known), number


def _load(window: int, number: int):
    """Bytes that each bucket would get."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, int] = {}
        for flush in _flushes(batches, window):
            strings = flush.packed(window)
            _, merged = merge(strings)
            new = np.unique(merged, return_index=True)[1]  # where each string comes first
            sizes = np.full(len(strings), _OCCURRENCE.itemsize)
            sizes[new] += [len(strings[k]) for k in new]
            buckets = flush.buckets(number)
            for bucket, load in zip(*sums(buckets, sizes), strict=True):
                total[bucket] = total.get(bucket, 0) + load
        yield pd.DataFrame({"bucket": list(total), "load": list(total.values())})

    return weigh


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
    different, place = np.unique(keys, return_inverse=True)
    return different.tolist(), np.bincount(place, values).astype(np.int64).tolist()


def _pack(window: int, number: int, heavy: frozenset[int]):
    """Rows of (bucket, compressed strings, compressed occurrences)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for flush in _flushes(batches, window):
            buckets = flush.buckets(number)
            strings = flush.packed(window)
            order = np.argsort(buckets, kind="stable")
            cuts = np.flatnonzero(np.diff(buckets[order])) + 1
            rows = []
            for part in np.split(order, cuts):
                bucket = int(buckets[part[0]])
                if bucket in heavy:
                    continue
                known, packed = merge([strings[k] for k in part])
                seen = np.zeros(len(part), _OCCURRENCE)
                docs = flush.doc[part]
                seen["packed"], seen["start"] = packed, flush.begin[part] - flush.first[docs]
                seen["doc"] = [flush.docs[d][0] for d in docs]
                seen["key"] = [flush.docs[d][1] for d in docs]
                rows.append((bucket, squeeze(b"\n".join(known)), squeeze(seen.tobytes())))
            yield pd.DataFrame(rows, columns=["bucket", "strings", "seen"])

    return pack


def _single(window: int, number: int, heavy: frozenset[int]):
    """One row per window of the heavy buckets: (digest, doc, key, start)."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.array(sorted(heavy), np.int64)
        for flush in _flushes(batches, window):
            runs = np.flatnonzero(np.isin(flush.buckets(number), wanted))
            rows = []
            for run in runs.tolist():
                doc, key, _ = flush.docs[flush.doc[run]]
                first = int(flush.first[flush.doc[run]])
                for at in range(int(flush.begin[run]), int(flush.begin[run] + flush.length[run])):
                    content = flush.line[flush.starts[at] : flush.ends[at + window - 1]]
                    rows.append((xxhash.xxh3_128_digest(content), doc, key, at - first))
            yield pd.DataFrame(rows, columns=["digest", "doc", "key", "start"])

    return spread


def _later_windows(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which windows (word numbers ``ids`` from ``at``) repeat an earlier one in the list."""
    value = np.zeros(len(at), np.uint64)
    for k in range(window):
        value = value * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64) + np.uint64(1)
    order = np.argsort(value, kind="stable")
    same = np.flatnonzero(value[order[1:]] == value[order[:-1]])
    left, right = at[order[same]], at[order[same + 1]]
    equal = np.ones(len(same), bool)
    for k in range(window):
        equal &= ids[left + k] == ids[right + k]
    later = np.zeros(len(at), bool)
    if equal.all():
        later[order[same + 1]] = True
        return later
    # Different windows with one hash: sort all by content instead.
    table = ids[at[:, None] + np.arange(window)]
    _, first, group = np.unique(table, axis=0, return_index=True, return_inverse=True)
    return first[group.ravel()] != np.arange(len(at))


def _judge(window: int):
    """A bucket's windows: stretches of words that occur earlier elsewhere."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor().decompress
        strings: defaultdict[bytes, int] = defaultdict(count().__next__)
        parts = []
        for packed, raw in zip(rows["strings"], rows["seen"], strict=True):
            own = np.fromiter(map(strings.__getitem__, expand(packed).split(b"\n")), np.int64)
            seen = np.frombuffer(expand(raw), _OCCURRENCE).copy()
            seen["packed"] = own[seen["packed"]]
            parts.append(seen)
        seen = np.concatenate(parts)
        seen = seen[np.lexsort((seen["packed"], seen["start"], seen["key"], seen["doc"]))]
        # Repeated rows are one document: the same string at the same place counts once.
        seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])]
        # Number the strings by their earliest occurrence.
        different, earliest, string = np.unique(seen["packed"], return_index=True, return_inverse=True)
        by_place = np.argsort(earliest, kind="stable")
        rank = np.empty_like(by_place)
        rank[by_place] = np.arange(len(by_place))
        string = rank[string]
        ordered = list(strings)
        ordered = [ordered[k] for k in different[by_place].tolist()]

        sizes = np.fromiter((s.count(b" ") + 1 for s in ordered), np.int64, len(ordered))
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(numbers.__getitem__, b" ".join(ordered).split(b" ")), np.int64)
        windows = sizes - (window - 1)
        owner = np.repeat(np.arange(len(ordered)), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        later = _later_windows(ids, (np.cumsum(sizes) - sizes)[owner] + inside, window)

        # The earliest occurrence of a string loses what is later there; all others lose everything.
        head = seen[earliest[by_place]]
        breaks = np.flatnonzero((np.diff(owner) != 0) | (np.diff(later.astype(np.int8)) != 0)) + 1
        begin = np.concatenate([[0], breaks])[: len(owner)]
        end = np.concatenate([breaks, [len(owner)]])[: len(owner)]
        begin, end = begin[later[begin]], end[later[begin]]
        first = head[owner[begin]]
        rest = np.ones(len(seen), bool)
        rest[earliest] = False
        other, wide = seen[rest], windows[string[rest]]
        return pd.DataFrame({
            "doc": np.concatenate([first["doc"], other["doc"]]),
            "key": np.concatenate([first["key"], other["key"]]),
            "low": np.concatenate([first["start"] + inside[begin], other["start"]]).astype(np.int64),
            "high": np.concatenate([first["start"] + inside[begin] + (end - begin), other["start"] + wide]).astype(np.int64)
            + (window - 1),
        })

    return judge


def document_key() -> tuple[Column, Column]:
    """What tells documents apart: the id (null is smallest), and a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("text")


def squeezed(texts: pd.Series) -> pd.Series:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return texts.map(lambda text: None if text is None else squeeze(text))


def with_spans(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """``docs`` with their stretches as the array ``_spans`` (null without any), and for ``text`` the compressed ``_text``.

    This is the one time that whole texts are shuffled.
    """
    doc, key = document_key()
    small: Callable[..., Column] = F.pandas_udf(squeezed, "binary")
    spans = stretches.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key"))
    spans = spans.agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    keyed = docs.withColumns({"_doc": doc, "_key": key, "_text": small(F.encode("text", "UTF-8"))}).drop("text")
    return keyed.join(spans, ["_doc", "_key"], "left")


def repeated(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """(doc, key, low, high): words [low, high) that an earlier window has as well; stretches may overlap."""
    doc, key = document_key()
    texts = docs.select(doc.alias("doc"), key.alias("key"), F.encode("text", "UTF-8").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    number = max(1, -(-3 * size // bucket))
    loads = texts.mapInPandas(_load(window, number), "bucket long, load long").groupBy("bucket").agg(F.sum("load").alias("load"))
    heavy = frozenset(r.bucket for r in loads.where(F.col("load") > HEAVY * bucket).select("bucket").collect())
    blobs = texts.mapInPandas(_pack(window, number, heavy), "bucket long, strings binary, seen binary")
    found = blobs.groupBy("bucket").applyInPandas(_judge(window), "doc long, key long, low long, high long")
    if not heavy:
        return found
    single = texts.mapInPandas(_single(window, number, heavy), "digest binary, doc long, key long, start long")
    place = F.struct("doc", "key", "start")
    least = single.groupBy("digest").agg(F.min(place).alias("least"))
    later = single.join(least, "digest").where(place > F.col("least"))
    return found.unionByName(later.select("doc", "key", F.col("start").alias("low"), (F.col("start") + window).alias("high")))


def _without(untouched: bool):
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        expand, rows = zstandard.ZstdDecompressor().decompress, []
        for text, cuts in zip(texts, spans, strict=True):
            text = expand(text) if text is not None else b""
            words, kept, at = text.split(), [], 0
            for low, high in sorted((c["low"], c["high"]) for c in cuts) if cuts is not None else ():
                kept += words[at : max(at, low)]
                at = max(at, high)
            kept += words[at:]
            left = text if untouched and len(kept) == len(words) else b" ".join(kept)
            rows.append((left.decode("utf-8", "replace"), len(words), len(words) - len(kept)))
        return pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])

    return cut


def without_repeats(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET, untouched: bool = False) -> DataFrame:
    """Add kept, n_words and n_removed to every row of ``docs``, instead of its text.

    ``kept`` has the words that stay joined by one space; with ``untouched``, a
    text that keeps all its words is as it was.
    """
    docs = docs.drop("kept", "n_words", "n_removed")
    cut: Callable[..., Column] = F.pandas_udf(_without(untouched), "kept string, n_words long, n_removed long")
    joined = with_spans(docs, repeated(docs, window, bucket)).withColumn("_cut", cut("_text", "_spans"))
    return joined.select(*[c for c in docs.columns if c != "text"], "_cut.kept", "_cut.n_words", "_cut.n_removed")
