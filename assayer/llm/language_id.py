"""Language identification with n-gram filters that hold a language bitmask per cell.

All languages share one Bloom filter that is sliced by bit: a cell is a word
with one bit per language, or several words where there are more than 64. The conjunction of an n-gram's cells names every
language whose n-grams may contain it. Hits are counted per language, corrected
for the share that the filter's fill would hit by chance, and the largest
corrected count decides.

The filter learns from at most ``sample`` documents per language (chosen by a
hash of the id, used with their whole text) and keeps the ``grams`` most
frequent n-grams of each language unless another language has them far more
often. It knows the ``languages`` most frequent languages (1,000), and from 100
languages on fewer n-grams of each (2,000,000 in all), so the model is of bounded
size. Prediction sees the text only.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; a
text whose n-grams no language knows gets the language with most learned
documents and score 0; without learnable rows everything is ``und``; equal
counts go to the alphabetically first language; a null ``doc_id`` is not learned
from but is predicted; languages beyond the bound are not learned; repeated rows
stay rows; further columns are kept, but for those named like a result and names
that begin with an underscore.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
SIZES = (3, 4)
HASHES = 3
#: Documents per language and n-grams per language that a model learns from.
SAMPLE, GRAMS = 2000, 20_000
#: How common an n-gram must be in a language, against the language that has it most.
RATIO = 0.34
#: Characters that are looked up at a time; a longer text is taken in several steps.
STEP = 1 << 18
#: Languages that are learned, and n-grams of all of them together.
LANGUAGES, ALL_GRAMS = 1000, 2_000_000
#: Languages in one word of a cell.
WORD = 64
#: Parts of a language that are ranked by themselves first.
PARTS = 64


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; everything but letters and marks is a space, runs of them are one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (points >= 97) & (points <= 122)
    other = points >= 0xAA
    points = np.where(ascii_letter | other, points, np.uint32(32))
    points = np.concatenate([np.array([32], np.uint32), points, np.array([32], np.uint32)])
    return points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]


def grams(text: str) -> np.ndarray:
    """64-bit numbers of the text's n-grams inside padded words, one for every occurrence."""
    codes = _codes(text).astype(np.uint64)
    space = codes == 32
    out = []
    for n in SIZES:
        if len(codes) < n:
            continue
        value, inner = np.full(len(codes) - n + 1, n, np.uint64), np.zeros(len(codes) - n + 1, bool)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
            if 0 < k < n - 1:
                inner |= space[k : len(codes) - n + 1 + k]
        out.append(value[~inner])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _cells(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        mixed = (values ^ (values >> np.uint64(31))) * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)[k])
        yield (mixed >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """The filter's cells and the chance of a false hit per language."""

    languages: list[str]
    fallback: str
    bits: int
    cells: np.ndarray
    chance: np.ndarray

    @classmethod
    def build(cls, learned: dict[str, np.ndarray], fallback: str) -> Model:
        languages = sorted(learned)
        most = max(map(len, learned.values()))
        bits = max(10, int(16 * most).bit_length())
        cells = np.zeros((-(-len(languages) // WORD), 1 << bits), np.uint64)
        for k, language in enumerate(languages):
            for at in _cells(learned[language], bits):
                np.bitwise_or.at(cells[k // WORD], at, np.uint64(1 << k % WORD))
        fill = np.array([(cells[k // WORD] >> np.uint64(k % WORD) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, fallback, bits, cells, fill**HASHES)

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """Hits per language and number of n-grams."""
        counts, total = np.zeros(len(self.languages)), 0
        for at in range(0, len(text), STEP):
            values = grams(text[at : at + STEP])
            first, *rest = _cells(values, self.bits)
            total += len(values)
            for word, known in enumerate(self.cells):
                masks = known[first]
                for cells in rest:
                    masks = masks & known[cells]
                for k in range(word * WORD, min(len(self.languages), (word + 1) * WORD)):
                    counts[k] += np.count_nonzero(masks & np.uint64(1 << k % WORD))
        return counts, total

    def predict(self, text: str) -> tuple[str, float]:
        counts, total = self.hits(text)
        sure = np.maximum(0.0, (counts - total * self.chance) / (1 - self.chance))
        best = int(np.argmax(sure))
        if not total or sure[best] <= 0:
            return self.fallback, 0.0
        return self.languages[best], float(min(1.0, sure[best] / total))


def _first(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each language: of its parts before, so no task ranks more than parts x ``most`` of them at last."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), key), F.lit(PARTS)))
    for group in (["lang", "part"], ["lang"]):
        parts = parts.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= most)
    return parts.drop("part", "nth")


def learn(rows: DataFrame, sample: int = SAMPLE, gram_count: int = GRAMS, languages: int = LANGUAGES) -> Model | None:
    """Fit on (doc_id, text, lang) rows; at most ALL_GRAMS n-grams, and 200 a language, reach the driver."""
    labelled = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages + 1).collect()
    if len(sizes) > languages:
        labelled = labelled.where(F.col("lang").isin([r.lang for r in sizes[:languages]]))
    gram_count = min(gram_count, max(200, ALL_GRAMS // max(1, len(sizes))))
    chosen = _first(labelled.select("doc_id", "lang"), "doc_id", [F.xxhash64("doc_id"), F.col("doc_id")], sample)
    # At most ``sample`` ids of each language, and languages are limited as well.
    taken = labelled.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                seen.setdefault(lang, Counter()).update(set(grams(text).tolist()))
            for lang, counter in seen.items():
                yield pd.DataFrame({"lang": lang, "gram": np.array(list(counter), np.uint64).view(np.int64), "n": list(counter.values())})

    totals = taken.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = _first(totals, "gram", [F.desc("n"), F.col("gram")], gram_count)
    counts: dict[str, dict[int, int]] = {}
    for row in top.select("lang", "gram", "n").collect():
        counts.setdefault(row.lang, {})[row.gram] = row.n
    if not counts:
        return None
    learned = characteristic(counts)
    fallback = sizes[0].lang if sizes[0].lang in learned else min(learned)
    return Model.build({lang: np.array(g, np.int64).view(np.uint64) for lang, g in learned.items()}, fallback)


def characteristic(counts: dict[str, dict[int, int]], ratio: float = RATIO) -> dict[str, list[int]]:
    """N-grams that are at least ``ratio`` as common in a language as where they are most common."""
    totals = {lang: sum(grams.values()) for lang, grams in counts.items()}
    most: dict[int, float] = {}
    for lang, seen in counts.items():
        for gram, n in seen.items():
            most[gram] = max(most.get(gram, 0.0), n / totals[lang])
    return {
        lang: [gram for gram, n in seen.items() if n / totals[lang] >= ratio * most[gram]] for lang, seen in counts.items()
    }


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred and score to rows with a ``text``."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    parts = (model.languages, model.fallback, model.bits, model.cells, model.chance)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # fixed size, see learn

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        local = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame(judged(local, texts), columns=["lang_pred", "score"])

    return docs.withColumn("_judged", judge("text")).select(
        *docs.columns, F.col("_judged.lang_pred").alias("lang_pred"), F.col("_judged.score").alias("score")
    )


def judged(model: Model, texts: Iterable[str | None]) -> list[tuple[str, float]]:
    return [model.predict(t) if t and any(map(str.isalpha, t)) else (UNKNOWN, 0.0) for t in texts]
