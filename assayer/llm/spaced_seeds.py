"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over neighbouring tokens: it hashes the marked ones and
ignores the rest, so a substituted word still leaves seeds that agree. Seeds of
the benchmark and of the training texts are joined by hash. Around every hit the
whole benchmark item is laid over the text and compared token by token; a text
is contaminated where a stretch agrees but for a few substitutions.

The benchmark is taken in blocks of bounded size. A block's seeds are broadcast,
so windows of texts are never shuffled, and neither are texts: a hit takes along
the words that lie under its item, and only those meet the item's words.

An overlap counts from ``LEAST`` words on, or with the whole item where that is
shorter. ``SEEDS`` leave an agreeing seed after any two substitutions in ten
words, ``SHORT_SEEDS`` after any one in five, so whatever the comparison accepts
is found. Under ``LEAST_SHORT`` words no word may differ, and an item is too
common to be looked for inside texts: it has to be the whole text.

Tokens are maximal runs of letters and digits, lower-cased. Defined cases: null
texts have no tokens; items without tokens are not searched;
repeated items or documents are found each under their id (rows with one id
count as one); a null id is an id of its own; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import let, settle

#: Masks for items of at least LEAST words and of LEAST_SHORT to LEAST - 1 words: 1 is hashed, 0 is ignored.
SEEDS, SHORT_SEEDS = ("111011", "1110101", "101000111"), ("1101", "1011")
LEAST, LEAST_SHORT = 10, 5
#: Words of a stretch that is compared, and the share of them that must agree.
STRETCH, AGREE = 13, 0.8
#: Seeds of one benchmark block; a seed takes about 30 bytes in the broadcast.
BLOCK_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def seeds(rows: DataFrame, token_column: str, masks: tuple[str, ...]) -> DataFrame:
    """(place, m, h) of every token window: the mask and the hash of what it marks."""
    used = sorted({k for mask in masks for k, bit in enumerate(mask) if bit == "1"})
    w = F.col(token_column)
    shifted = [F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - k, F.lit(0))).alias(f"t{k}") for k in used]
    windows = rows.select("*", F.posexplode(F.arrays_zip(*shifted)).alias("place", "t"))
    # A mask that reaches past the last token has no hash.
    hashes = [
        F.when(
            F.col(f"t.t{len(mask) - 1}").isNotNull(),
            F.xxhash64(*[F.col(f"t.t{k}") for k, bit in enumerate(mask) if bit == "1"]),
        )
        for mask in masks
    ]
    marks = F.explode(F.array(*[F.struct(F.lit(mask).alias("m"), h.alias("h")) for mask, h in zip(masks, hashes, strict=True)]))
    found = windows.withColumn("s", marks).drop("t").where("s.h IS NOT NULL")
    return found.withColumns({"m": F.col("s.m"), "h": F.col("s.h")}).drop("s")


def _stretch(doc: Column, item: Column) -> Column:
    """(most agreeing words in a stretch, words in a stretch, agreeing words overall)."""
    flags = F.zip_with(doc, item, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))

    def best(f: Column) -> Column:
        width = F.least(F.size(f), F.lit(STRETCH))
        total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
        sums = F.transform(F.sequence(F.lit(1), F.size(f) - width + 1), lambda k: total(F.slice(f, k, width)))
        return F.struct(F.array_max(sums).alias("agree"), width.alias("width"), total(f).alias("overall"))

    return let(flags, best)


def _hits(texts: DataFrame, items: DataFrame, kinds: set[str]) -> DataFrame:
    """Where a benchmark item may lie in a text: one row for each shift between the two.

    ``shift`` is the place in the text minus the place in the item; ``under`` are the
    text's words from there on, as many as lie under the item. ``kinds`` are the
    kinds of items there are.
    """
    cut = texts.select("doc_id", "doc_key", tokens(F.col("text")).alias("doc_tokens"))
    known = items.withColumn("item_words", F.size("item_tokens"))
    found = []
    for kind, masks in (("long", SEEDS), ("short", SHORT_SEEDS)):
        if kind in kinds:
            sought = seeds(known.where(F.col("kind") == kind), "item_tokens", masks)
            sought = sought.select("item_id", "item_key", "item_words", F.col("place").alias("item_place"), "m", "h")
            met = seeds(cut, "doc_tokens", masks).join(F.broadcast(sought), ["m", "h"])
            found.append(met.withColumn("shift", F.col("place") - F.col("item_place")))
    if "whole" in kinds:
        sought = known.where("kind = 'whole'").select("item_id", "item_key", "item_words", F.col("item_tokens").alias("doc_tokens"))
        found.append(cut.join(F.broadcast(sought), "doc_tokens").withColumn("shift", F.lit(0)))
    # An item that begins before the text lies over its first words only.
    covered = F.slice("doc_tokens", F.greatest("shift", F.lit(0)) + 1, F.col("item_words") + F.least("shift", F.lit(0)))
    columns = ["doc_id", "doc_key", "item_id", "item_key", "item_words", "shift", covered.alias("under")]
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in found]).distinct()


def _overlaps(texts: DataFrame, items: DataFrame, kinds: set[str]) -> DataFrame:
    """Best verified overlap of every (document, item) of one benchmark block."""
    hits = _hits(texts, items, kinds)
    laid = hits.where(F.size("under") >= F.least("item_words", F.lit(LEAST))).join(
        F.broadcast(items.select("item_key", "item_tokens")), "item_key"
    )
    doc_start, item_start = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    checked = laid.select(
        "doc_id", "item_id", doc_start.alias("doc_start"), item_start.alias("item_start"), "item_words",
        _stretch(F.col("under"), F.slice("item_tokens", item_start + 1, F.size("under"))).alias("found"),
    ).where(F.col("found.agree") >= AGREE * F.col("found.width"))
    best = F.max(
        F.struct("found.overall", (-F.col("doc_start")).alias("doc"), (-F.col("item_start")).alias("item"), "item_words")
    )
    return checked.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.overall").cast("long").alias("agreeing_words"),
        F.col("best.item_words").cast("long").alias("item_words"),
        (-F.col("best.doc")).cast("long").alias("doc_start"), (-F.col("best.item")).cast("long").alias("item_start"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id) with the place and extent of the best overlap."""
    item_tokens, n = tokens(F.col("text")), F.size("item_tokens")
    items = settle(
        benchmark.select("item_id", item_tokens.alias("item_tokens"))
        .dropDuplicates()
        .where(n > 0)
        .withColumn("kind", F.when(n >= LEAST, "long").when(n >= LEAST_SHORT, "short").otherwise("whole"))
        .withColumn("item_key", F.xxhash64("item_id", "item_tokens")),
        "benchmark-tokens",
    )
    wanted, kinds = items.agg(F.sum(F.size("item_tokens").cast("long")), F.collect_set("kind")).first()
    blocks = max(1, -(-(wanted or 0) * len(SEEDS) // block_seeds))
    texts = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    parts = [
        _overlaps(texts, items.where(F.pmod("item_key", F.lit(blocks)) == block), set(kinds) or {"long"})
        for block in range(blocks)
    ]
    return reduce(DataFrame.unionByName, parts)
