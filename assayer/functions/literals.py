"""Which patterns can match a text at all, found in one pass.

Every pattern is reduced to literals of which each of its matches holds at least
one. An Aho-Corasick automaton over all of them reads a text once and sets the bit
of every pattern that has a literal there; a pattern without a literal keeps its
bit set. Tests behind a bit that is not set need not run.

``Guard.exact`` goes further: RE2 settles every pattern on the texts of a batch at
once. The JVM's regular expressions decide only where the two might differ, on
characters outside ``ALIKE``, and there the automaton tells which ones need to run.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters on which the JVM and RE2 agree, whatever their Unicode version: none ends a line or is folded into ASCII.
ALIKE = r"^[\x20-\x7e\x{a1}-\x{ff}\x{900}-\x{97f}\x{980}-\x{9fe}\x{2010}-\x{2027}\x{20b9}]*$"
#: Set where a text's bits are settled; else a set bit is a pattern that may match.
SETTLED = 1 << 62
#: Bits of a text that nothing is known about.
UNKNOWN = SETTLED - 1


def required(pattern: str) -> frozenset[str] | None:
    """Literals of which every match holds one; None where no literal is certain. The longest choice of a sequence counts."""
    return _of(_parser.parse(pattern))


def _of(parsed) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run = ""
    for kind, value in [*parsed, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if kind is op.SUBPATTERN:
            inner = _of(value[-1])
        elif kind is op.BRANCH:
            parts = [_of(part) for part in value[1]]
            inner = None if None in parts else reduce(frozenset.union, parts)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            inner = _of(value[2])
        if inner is not None:
            found.append(inner)
    return max(found, key=lambda literals: (min(map(len, literals)), -len(literals)), default=None)


class Guard:
    """Bits of named patterns, at most 62 of them; with ``fold`` for patterns that fold case, with literals in lower case."""

    def __init__(self, patterns: Mapping[str, str], fold: bool = False):
        if len(patterns) > 62:
            raise ValueError("more than 62 patterns")
        self.patterns, self.fold = list(patterns.values()), fold
        self.bit = {name: 1 << k for k, name in enumerate(patterns)}
        self.always, self.masks = 0, {}
        for name, pattern in patterns.items():
            literals = required(pattern)
            if literals is None:
                self.always |= self.bit[name]
            for literal in literals or ():
                self.masks[literal] = self.masks.get(literal, 0) | self.bit[name]

    def bits(self, *names: str) -> int:
        return reduce(int.__or__, (self.bit[n] for n in names), 0)

    def exact(self, texts: Column) -> Column:
        """The bits of every text of an array: of the patterns that match, with ``SETTLED``, or of those that may match."""
        masks, always, patterns, fold, alike, settled = self.masks, self.always, self.patterns, self.fold, ALIKE, SETTLED

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def scan(lists: pa.Array) -> pa.Array:
            texts = lists.flatten()
            bits = np.full(len(texts), settled, np.int64)
            for k, pattern in enumerate(patterns):
                held = pc.match_substring_regex(texts, pattern).fill_null(False)
                bits |= held.to_numpy(zero_copy_only=False).astype(np.int64) << k
            odd = np.flatnonzero(~pc.match_substring_regex(texts, alike).fill_null(True).to_numpy(zero_copy_only=False))
            if len(odd):
                import ahocorasick

                automaton = ahocorasick.Automaton()
                for literal, mask in masks.items():
                    automaton.add_word(literal, mask)
                automaton.make_automaton()
                for at in odd.tolist():
                    bits[at] = always
                    text = texts[at].as_py()
                    for _, mask in automaton.iter(text.lower() if fold else text):
                        bits[at] |= mask
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(bits), mask=lists.is_null())

        return scan(texts)


def may(mask: Column, bits: int) -> Column:
    """All of these bits are set."""
    return mask.bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits).cast("long")


def holds(mask: Column, bits: int, test: Column) -> Column:
    """All of these bits are set, and ``test`` agrees where the mask is not settled."""
    return may(mask, bits) & ((mask >= F.lit(SETTLED)) | test)
