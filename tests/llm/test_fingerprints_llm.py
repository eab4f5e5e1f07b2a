"""One-permutation fingerprints against exact shingle sets and a plain walk over the sorted table."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from test_operators_llm import prose

from assayer.llm import oph_fingerprints as oph

LONG = prose(1, 400)


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _rows():
    rows = [(k * 3, prose(50 + k, 5 + 7 * k)) for k in range(25)]
    rows += [(1, None), (2, ""), (4, " \n "), (5, "one"), (7, "é" * 10), (8, "\U0001f600 a b"), (None, prose(2, 30)), (None, None)]
    rows += [(10, LONG), (11, LONG.replace(" ", "\t")), (2**53 + 1, "far"), (2**53, "away"), (-5, "below zero")]
    rows += [(12, prose(3, 40))] * 3 + [(12, prose(4, 40)), (12, prose(5, 40))] + [(20, prose(300 + k, 12)) for k in range(40)]
    return rows


def _brute(spark, rows):
    """(doc_id, n_chars, edited text, next text) of every row, in a ring by descending id."""
    hashes = [r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("xxhash64(t) AS h").collect()]
    order = sorted(zip(rows, hashes, strict=True), key=lambda x: (x[0][0] is None, -(x[0][0] or 0), x[1]))
    texts = [t or "" for (_, t), _ in order]
    for k, ((doc_id, _), _) in enumerate(order):
        own, following = texts[k], texts[(k + 1) % len(texts)]
        third = len(own) // 3
        yield doc_id, len(own), own[: len(own) - third] + following[:third], own, following


@pytest.mark.parametrize("rows_a_range", [1, 3, 10, 1000])
def test_ring_of_neighbours(spark, docs_of, rows_a_range):
    rows = _rows()
    random.Random(2).shuffle(rows)
    docs = docs_of(rows, text_next="clash", h="clash", id="clash")
    got = Counter((r.doc_id, r.n_chars, r.edited_text, r.near_next, r.near_edited) for r in oph.fingerprints(docs, rows_a_range).collect())
    prints = {t: oph.fingerprint(t.encode()) for _, _, e, o, f in _brute(spark, rows) for t in (e, o, f)}
    want = Counter(
        (i, n, e, oph.likeness(prints[own], prints[f]), oph.likeness(prints[own], prints[e])) for i, n, e, own, f in _brute(spark, rows)
    )
    assert got == want


def test_one_row_and_no_row(spark, docs_of):
    (row,) = oph.fingerprints(docs_of([(3, "abcdef")])).collect()
    assert (row.n_chars, row.edited_text, row.near_next) == (6, "abcdab", 1.0)
    assert oph.fingerprints(docs_of([])).count() == 0


def test_likeness_is_the_jaccard_similarity():
    r, off = random.Random(5), []
    for _ in range(150):
        base = prose(r.randint(0, 999), r.randint(40, 900)).split()
        other = base[: r.randint(0, len(base))] + prose(r.randint(1000, 1999), r.randint(1, 500)).split()
        a, b = " ".join(base), " ".join(other)
        off.append(oph.likeness(oph.fingerprint(a.encode()), oph.fingerprint(b.encode())) - _jaccard(a, b))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_texts_without_words_and_equal_texts():
    empty, word = oph.fingerprint(b""), oph.fingerprint(b"word")
    assert oph.fingerprint(None) == empty == oph.fingerprint(b" \t\n") == b""
    assert oph.likeness(empty, empty) == 1 and oph.likeness(empty, word) == 0 == oph.likeness(word, empty)
    assert oph.fingerprint(LONG.encode()) == oph.fingerprint(LONG.encode().upper())
    assert len(word) == oph.BINS * oph.BITS // 8


def test_empty_bins_take_the_value_of_one_that_is_not():
    values = oph.bins_of(b"a b c d e f")  # two shingles fill 512 bins
    assert len(set(values.tolist())) == 2
    assert 150 < Counter(values.tolist()).most_common()[0][1] < 362


def test_blocks_do_not_change_the_result(monkeypatch):
    whole = oph.fingerprint(LONG.encode())
    monkeypatch.setattr(oph, "_STEP", 7)
    assert oph.fingerprint(LONG.encode()) == whole
