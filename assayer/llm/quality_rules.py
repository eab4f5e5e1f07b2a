"""Quality rules: a decision list learned by sequential covering.

Statistics of every document are plain columns. From the labelled ones, rules
grow one threshold at a time, each the condition that separates bad from good
best; every rule is then pruned on rows it did not grow on, and covered rows
leave before the next rule starts. The finished list is one ordered Spark
``CASE WHEN`` expression; documents that no rule covers are good.

Learning reads counts per (statistic, threshold) only: each step is one
aggregate whose result has a few hundred rows, as thresholds are quantiles. All
labelled rows take part, whatever their number.

Defined cases: a null or blank text has all statistics 0 and fails the base
rule; labels that are null, or of unknown documents, teach nothing; a document
with contradicting labels counts once for each; without labels, or with labels
of one kind only, the list is empty and the base rule decides; repeated rows
are judged each; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import let, settle, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _count(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def repeated_words(tokens: Column) -> Column:
    """Words inside three-word windows that the text has at least twice.

    Windows are sorted with their places; a window equal to a neighbour repeats.
    A window at place p adds the words beyond the previous repeated window.
    """

    def covered(windows: Column) -> Column:
        return let(F.sort_array(windows), _covered)

    def _covered(run: Column) -> Column:
        here = F.transform(
            run,
            lambda x, k: F.when(
                x["w"].eqNullSafe(F.get(run, k - 1)["w"]) | x["w"].eqNullSafe(F.get(run, k + 1)["w"]), x["i"]
            ),
        )
        places = F.sort_array(F.filter(here, lambda p: p.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            places, start,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    def per_text(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        joined = lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))

        def if_any(three: Column) -> Column:
            windows = F.transform(three, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
            return F.when(F.size(F.array_distinct(three)) == F.size(three), F.lit(0)).otherwise(covered(windows))

        return let(F.transform(heads, joined), if_any)

    return let(tokens, per_text).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts over the whole text of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = words(text)
    lines = let(
        F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))),
        lambda kept: F.struct(
            F.size(kept).alias("n"), (F.size(kept) - F.size(F.array_distinct(kept))).alias("repeated")
        ),
    )
    black = F.translate(text, " \t\n\x0b\x0c\r", "")
    counted = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        let(tokens, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))).alias("w"),
        lines.alias("l"),
        F.length(black).cast("long").alias("word_chars"),
        reduce(lambda a, b: a + b, [_count(F.col("text"), s) for s in SYMBOLS]).cast("long").alias("n_symbols"),
        _count(F.col("text"), "!").cast("long").alias("n_exclaims"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
    )
    return counted.select(
        "doc_id", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.repeated").cast("long").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"), "n_exclaims", "n_upper",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: What rules may ask about: shares of two statistics, so that a long text is not worse than a short one.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    part, whole = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature(self.feature)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """Number of the first rule that covers a row, null where none does."""
        chain = None
        for number, rule in enumerate(self.rules, 1):
            chain = F.when(rule.column(), number) if chain is None else chain.when(rule.column(), number)
        return F.lit(None).cast("int") if chain is None else chain

    def reason(self) -> Column:
        """The first covering rule in words."""
        chain = None
        for rule in self.rules:
            chain = F.when(rule.column(), str(rule)) if chain is None else chain.when(rule.column(), str(rule))
        return F.lit(None).cast("string") if chain is None else chain


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information gained about covered bad rows when (p0, n0) shrinks to (p1, n1)."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


#: (bad, good) per side, statistic and bin.
Cells = dict[tuple[bool, str, int], tuple[int, int]]


def _counts(rows: DataFrame, features: list[str]) -> Cells:
    """Counts of the rows that grow rules (False) and of those that prune them (True); one aggregate of bounded size."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in features]))
    table = rows.select("prunes", cells.alias("cell"), "bad").groupBy("prunes", "cell.f", "cell.b")
    return {
        (r.prunes, r.f, r.b): (r.p, r.n - r.p)
        for r in table.agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count("*").alias("n")).collect()
    }


@dataclass(frozen=True)
class Choice:
    """A condition with the (bad, good) rows it covers on either side."""

    condition: Condition
    grown: tuple[int, int]
    pruned: tuple[int, int]

    @property
    def side(self) -> tuple[str, bool]:
        return self.condition.feature, self.condition.above


def _choices(cells: Cells, cuts: dict[str, list[float]]) -> list[Choice]:
    """Every threshold of every statistic, in both directions."""
    found = []
    for f, values in cuts.items():
        whole = [tuple(map(sum, zip(*[n for (side, g, _), n in cells.items() if side == prunes and g == f] or [(0, 0)], strict=True))) for prunes in (False, True)]
        low = [(0, 0), (0, 0)]
        for b, threshold in enumerate(values):
            low = [tuple(x + y for x, y in zip(low[k], cells.get((k == 1, f, b), (0, 0)), strict=True)) for k in (0, 1)]
            high = [(w[0] - x[0], w[1] - x[1]) for w, x in zip(whole, low, strict=True)]
            found += [Choice(Condition(f, True, threshold), *high), Choice(Condition(f, False, threshold), *low)]
    return found


def learn(
    stats: DataFrame,
    labels: DataFrame,
    bins: int = 32,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_support: int = 5,
) -> DecisionList:
    """Learn which labelled documents have quality 0.

    Two thirds of the labelled rows grow rules and one third prunes them. A rule
    stays only if at least ``min_precision`` of what it covers is bad among
    either, and it covers ``min_support`` bad rows it grew on. A candidate that
    does not is set aside with its first statistic and direction, and the next one
    grows; rules are added until no candidate qualifies.
    """
    marked = labels.where(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("bad"))
    features = [feature(f).alias(f) for f in FEATURES]
    prunes = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    labelled = settle(
        stats.join(marked, "doc_id").select(prunes.alias("prunes"), "bad", *stats.columns, *features), "labelled"
    )
    cuts = _thresholds(labelled, bins)
    if not cuts:
        return DecisionList()
    coded = [_bin(f, values).alias(f"b_{f}") for f, values in cuts.items()]
    rows = settle(labelled.select("prunes", "bad", *stats.columns, *coded), "labelled-bins")

    learned, aside = DecisionList(), set()
    while True:
        rest = rows.where(learned.fired().isNull())
        cells = _counts(rest, list(cuts))
        first = next(iter(cuts))
        if sum(p for (side, f, _), (p, _n) in cells.items() if f == first and not side) < min_support:
            return learned
        rule = None
        while rule is None:
            grown = _grow(rest.where(~F.col("prunes")), cells, cuts, max_conditions, aside)
            if grown is None:
                break
            rule = _prune(rest, grown, min_precision, min_support)
            if rule is None:
                aside.add((grown.conditions[0].feature, grown.conditions[0].above))
        # A threshold too far out to gain much may still be a sound rule by itself.
        rule = rule or _single(cells, cuts, min_precision, min_support)
        if rule is None:
            return learned
        learned.rules.append(rule)


def _sound(counts: tuple[int, int], min_precision: float) -> bool:
    p, n = counts
    return p > 0 and p >= min_precision * (p + n)


def _single(cells: Cells, cuts: dict[str, list[float]], min_precision: float, min_support: int) -> Rule | None:
    """The condition that covers most bad rows among those that qualify alone."""
    sound = [c for c in _choices(cells, cuts) if c.grown[0] >= min_support and _sound(c.grown, min_precision) and _sound(c.pruned, min_precision)]
    best = max(sound, key=lambda c: (c.grown[0] - c.grown[1], str(c.condition)), default=None)
    return Rule((best.condition,)) if best else None


def _bin(f: str, cuts: list[float]) -> Column:
    """How many thresholds the value reaches."""
    return F.size(F.filter(F.lit(cuts), lambda t: t <= F.col(f)))


def _thresholds(labelled: DataFrame, bins: int) -> dict[str, list[float]]:
    """Quantiles of all growing rows, more of them in the tails, and of the bad ones alone; halfway to the next value below."""
    steps = [k / bins for k in range(1, bins)]
    tails = [1 / (bins * 2**k) for k in range(1, 7)]
    shares = sorted({*steps, *tails, *[1 - t for t in tails]})
    grown = labelled.where(~F.col("prunes"))
    bad = {f: F.when(F.col("bad"), F.col(f)) for f in FEATURES}
    found = grown.agg(
        *[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES],
        *[F.percentile_approx(bad[f], shares, 10_000).alias(f"bad_{f}") for f in FEATURES],
    ).first()
    at = {f: sorted({*(found[f] or []), *(found[f"bad_{f}"] or [])}) for f in FEATURES}
    if not any(at.values()):
        return {}
    # The greatest value between two neighbouring thresholds, one row each; what lies below a threshold is the greatest of all before.
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), _bin(f, at[f]).alias("b"), F.col(f).cast("double").alias("v")) for f in FEATURES if at[f]]))
    highest = grown.select(cells.alias("cell")).groupBy("cell.f", "cell.b").agg(F.max(F.when(~F.isnan("cell.v"), F.col("cell.v"))).alias("top"))
    top = {(r.f, r.b): r.top for r in highest.collect() if r.top is not None}
    cuts = {}
    for f, values in at.items():
        under, cuts[f] = None, []
        for k, v in enumerate(values):
            under = max((x for x in (under, top.get((f, k))) if x is not None), default=None)
            if under is not None:
                cuts[f].append((v + under) / 2)
        cuts[f] = sorted(set(cuts[f]))
    return {f: values for f, values in cuts.items() if values}


def _grow(rows: DataFrame, cells: Cells, cuts: dict[str, list[float]], most: int, aside: set[tuple[str, bool]]) -> Rule | None:
    """Add the condition of the greatest gain while there is one; the first one is none that was set aside."""
    conditions: list[Condition] = []
    while len(conditions) < most:
        if conditions:
            cells = _counts(reduce(lambda df, c: df.where(c.column()), conditions, rows), list(cuts))
        choices = _choices(cells, cuts)
        p0, n0 = (sum(x) for x in zip(choices[0].grown, choices[1].grown, strict=True))
        if not p0 or not n0:
            break
        gains = [(_gain(p0, n0, *c.grown), -k) for k, c in enumerate(choices) if conditions or c.side not in aside]
        gain, place = max(gains, default=(0.0, 0))
        if gain <= 1e-9:
            break
        conditions.append(choices[-place].condition)
    return Rule(tuple(conditions)) if conditions else None


def _prune(rest: DataFrame, rule: Rule, min_precision: float, min_support: int) -> Rule | None:
    """Keep the beginning of the rule that does best on the rows set apart for pruning."""
    heads = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    bad, prunes = F.col("bad").cast("long"), F.col("prunes")
    sums = []
    for k, head in enumerate(heads):
        for name, side in (("g", ~prunes), ("q", prunes)):
            hit = (head.column() & side).cast("long")
            sums += [F.sum(hit * bad).alias(f"{name}p{k}"), F.sum(hit * (1 - bad)).alias(f"{name}n{k}")]
    got = {key: value or 0 for key, value in rest.agg(*sums).first().asDict().items()}

    def worth(k: int) -> tuple[float, int]:
        p, n = got[f"qp{k}"], got[f"qn{k}"]
        return ((p - n) / (p + n) if p + n else -1.0, -k)

    best = max(range(len(heads)), key=worth)
    for name in "gq":
        p, n = got[f"{name}p{best}"], got[f"{name}n{best}"]
        if p < min_precision * (p + n) or not p:
            return None
    return heads[best] if got[f"gp{best}"] >= min_support else None


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics, base rule, first learned rule that fires, and the verdict of every document."""
    stats = settle(statistics(docs), "quality-statistics")
    learned = learn(stats, labels, **options)
    return stats.select(
        "*", base_failed().alias("base_failed"), learned.reason().alias("rule")
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
