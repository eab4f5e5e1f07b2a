"""The pipeline's stages against brute force, each on its own input, and their hand-over."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from test_operators_llm import OTHER, PASSAGE, brute_components, brute_contaminated, brute_fingerprint, brute_words, prose

import corpus_pipeline

ITEM = prose(70, 40)


def _rows():
    r = random.Random(4)
    rows = [(k, prose(100 + k, r.randint(30, 200)), "en" if k % 2 else "de") for k in range(60)]
    copy = prose(100, 150)
    rows += [(200 + k, copy, "en") for k in range(5)] + [(300, copy.replace(" ", "  "), "en")]
    rows += [(400, PASSAGE, "en"), (401, prose(7, 20) + " " + PASSAGE, "en"), (402, PASSAGE + " " + PASSAGE, "en"), (403, OTHER, None)]
    rows += [(500, prose(8, 20) + " " + ITEM + " " + prose(9, 20), "en"), (501, None, "en"), (502, "", "en"), (503, "12 34 !!", "en")]
    rows += [(None, prose(10, 60), "en"), (None, prose(11, 60), "en"), (5, prose(105, 50), "en"), (400, PASSAGE, "en")]
    return rows


@pytest.fixture
def folder_of(spark, docs_of, tmp_path):
    def build(rows):
        docs_of(rows, lang_pred="clash").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, ITEM), (2, None)], "item_id int, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return build


def test_stages(spark, folder_of):
    folder = folder_of(_rows())
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
        docs = corpus_pipeline.settle(stage(spark, docs, folder), name)
        assert name == "best_fit_packing" or docs.columns == corpus_pipeline.COLUMNS
    start, spoken, firsts, cut, clean = seen
    # Language: only texts without letters go, as all others are in learned languages.
    assert Counter(spoken) == Counter((i, t) for i, t in start if t and any(map(str.isalpha, t)))
    # Near copies: of every group of texts chained by five-word Jaccard 0.8 or more, the row with the smallest id, rows without ids last.
    group = brute_components(sorted({t for _, t in spoken}), lambda a, b: _similar(a, b))
    least: dict[str, tuple] = {}
    for i, t in spoken:
        least[group[t]] = min((i is None, i or 0), least.get(group[t], (True, 0)))
    assert Counter(i for i, _ in firsts) == Counter(i if not missing else None for missing, i in least.values())
    assert Counter(group[t] for _, t in firsts) == Counter(least.keys())
    # Repeated passages: what is left, and untouched texts as they were.
    left = {(i, kept): n for (i, total, gone, kept), n in brute_words(firsts, 20).items() if gone < total or not total}
    assert Counter((i, " ".join(t.split())) for i, t in cut) == Counter(left)
    assert {t for _, t in firsts} >= {t for i, t in cut if i is not None and i < 60 and i != 5}
    # Benchmark: exactly the documents that hold an item.
    leaked = {i for i, _ in brute_contaminated(cut, [(1, ITEM)])}
    assert 500 in leaked and Counter(clean) == Counter(x for x in cut if x[0] not in leaked)
    # Packing: every document in whole pieces.
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in clean}


def test_run_on_an_empty_table(spark, folder_of):
    assert corpus_pipeline.run(spark, folder_of([])).count() == 0


def _shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def _similar(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def _changed(text, places):
    return " ".join("other" if k in places else w for k, w in enumerate(text.split()))


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_copies_against_all_pairs(spark, bucket):
    from assayer.llm.near_copies import near_copies

    r, rows = random.Random(8), []
    for base in range(12):
        text = prose(300 + base, 150)
        rows += [_changed(text, r.sample(range(150), n)) for n in (0, 1, 1, 2, 2, 3, 4, 6)]
    want = brute_components(sorted(set(rows)), _similar)
    docs = spark.createDataFrame(list(enumerate(rows)), "row_id long, text string").selectExpr("row_id", "row_id AS doc_id", "text")
    got = {rows[x.row_id]: x.component for x in near_copies(docs, bucket).collect()}
    pairs = lambda label: {(a, b) for a in label for b in label if label[a] == label[b]}
    assert pairs(got) == pairs(want)
    bits = {t: brute_fingerprint(t) for t in set(rows)}
    assert any(a < b and (bits[a] ^ bits[b]).bit_count() > 3 and _similar(a, b) for a in bits for b in bits)


@pytest.mark.parametrize(("block", "shingles"), [(512, 1 << 20), (7, 1 << 20), (512, 900)])
def test_near_copies_of_a_large_group_make_no_row_for_a_pair(spark, monkeypatch, block, shingles):
    from assayer.llm import near_copies

    compared, alike = [], near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *rest: compared.append(pairs.distinct().count()) or alike(pairs, *rest))
    monkeypatch.setattr(near_copies, "BLOCK", block, raising=False)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", shingles, raising=False)
    r, text = random.Random(12), prose(700, 150)
    rows = [_changed(text, r.sample(range(150), r.choice((2, 3, 5)))) for _ in range(150)] + [prose(701, 150)]
    rows += [_changed(rows[k], {r.randrange(150)}) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "row_id long, text string").selectExpr("row_id", "row_id AS doc_id", "text")
    got = {rows[x.row_id]: x.component for x in near_copies.near_copies(docs, 2).collect()}
    want = brute_components(sorted(set(rows)), _similar)
    assert len(set(want.values())) > 20 and len({(got[t], want[t]) for t in got}) == len(set(want.values())) == len(set(got.values()))
    assert sum(compared) <= near_copies.BANDS * len(rows)


def test_rows_are_told_apart_by_id_and_text(spark, folder_of):
    near = prose(400, 150)
    rows = [(1, prose(401, 60)), (1, prose(402, 60)), (2, near), (1, prose(401, 60)), (3, _changed(near, {9}))]
    rows += [(None, prose(403, 60)), (None, prose(403, 60)), (None, prose(404, 60) + " " + ITEM), (1, prose(405, 30) + " " + ITEM)]
    folder = folder_of(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    firsts = corpus_pipeline.keep_first_copies(spark, docs, folder)
    kept = Counter((r.doc_id, r.text) for r in firsts.collect())
    assert kept == Counter(set(rows) - {rows[4]})
    clean = corpus_pipeline.drop_contaminated(spark, firsts, folder)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in kept if ITEM not in x[1])


def test_near_copies_are_searched_by_fingerprints(spark, monkeypatch):
    """SimHash finds the close pairs on its own: no band brings them together here."""
    from assayer.llm import near_copies

    sketch = near_copies._sketch
    monkeypatch.setattr(near_copies, "_sketch", lambda text: (*sketch(text)[:3], []))
    base = prose(600, 400)
    code = lambda text: near_copies.simhash.fingerprint(text.encode(), near_copies.SHINGLE)
    near = next(t for t in (_changed(base, {k}) for k in range(400)) if 0 < (code(base) ^ code(t)).bit_count() <= 3)
    rows = [base, near, prose(601, 400), base.replace(" ", "  "), "", None, "one two"]
    docs = spark.createDataFrame(list(enumerate(rows)), "row_id long, text string").selectExpr("row_id", "row_id AS doc_id", "text")
    group = {r.row_id: r.component for r in near_copies.near_copies(docs).collect()}
    assert group[0] == group[1] == group[3] and group[4] == group[5]
    assert len(set(group.values())) == 4
