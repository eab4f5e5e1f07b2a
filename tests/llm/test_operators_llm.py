"""Every operator against a brute-force version, with nulls, ties, repeats, long texts and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import (
    language_id,
    mincut_html,
    packing,
    quality_rules,
    simhash,
    slots,
    spaced_seeds,
    suffix_array,
    superkmer,
    url_trie,
)
from assayer.llm.queries import URL_RULES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) + str(r.randint(0, vocabulary)) for _ in range(n))


PASSAGE, OTHER = prose(1, 45), prose(2, 60)
TEXTS = [
    (5, PASSAGE), (3, prose(3, 30) + "\n" + PASSAGE + " " + prose(4, 30)), (9, None), (10, ""), (11, " \t\n\x0b "),
    (12, "one two"), (4, OTHER), (8, OTHER), (7, OTHER + " tail"), (None, OTHER), (13, "na " * 500), (14, OTHER + "\n" + OTHER),
    (15, prose(5, 5000) + " " + PASSAGE), (16, "\u00a0x\u2003y " * 40), (17, "A#b ** c\nA#b ** c\n\nA#b ** c|"), (20, "ab" * 300),
]


# ---- quality rules


def brute_statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_statistics(docs_of):
    rows = quality_rules.statistics(docs_of(TEXTS, n_words="clash")).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *brute_statistics(t)) for i, t in TEXTS)


def test_decision_list_learns_and_keeps_clean(spark, docs_of):
    good = [(k, prose(k, 80)) for k in range(120)]
    bad = [(1000 + k, " ".join(w + "##" for w in prose(5000 + k, 80).split())) for k in range(60)]
    labels = spark.createDataFrame(
        [(i, 1) for i, _ in good[:100]] + [(i, 0) for i, _ in bad[:50]] + [(1, None), (777777, 0)], "doc_id long, quality int"
    )
    judged = quality_rules.judge(docs_of(good + bad + TEXTS), labels).collect()
    kept = {r.doc_id for r in judged if r.kept}
    assert {i for i, _ in good} <= kept and not {i for i, _ in bad} & kept
    assert all("symbols_per_word" in r.rule for r in judged if (r.doc_id or 0) >= 1000)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in judged)


def test_decision_list_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality_rules.judge(docs_of(TEXTS), none)
    assert judged.where("kept = base_failed OR rule IS NOT NULL").count() == 0
    assert quality_rules.judge(docs_of([]), none).count() == 0


def test_conditions_are_ordered_case_when():
    rule = quality_rules.Rule((quality_rules.Condition("upper_share", True, 0.5), quality_rules.Condition("chars_per_word", False, 3.0)))
    assert str(rule) == "upper_share >= 0.5 and chars_per_word < 3"


# ---- URL filters


def brute_verdict(url, rules):
    m = re.search(r"://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (h.count(".") + 1, len(p), a == "block", h + p, a)
        for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *((max(fits)[3], max(fits)[4]) if fits else (None, "allow")))


URLS = [
    "http://a.EXAMPLE.org/es/x", "https://example.org/en/17?q=1", "http://example.org/en/2", "http://org/", "http://org", "x://forg/",
    "http://b.com/fr/1", "http://b.com/de/#t", "http://b.com/de", "http://b.com/dex/", None, "", "no scheme/b.com/de/", "http://",
    "http://é.com/de/", "http://a..com/de/x", "http://u@b.com:8/de/", "http://b.com/de/http://example.org/es/", "http://b.com//de/\n",
]


def test_url_trie_and_join_agree_with_brute_force(spark):
    r = random.Random(0)
    rules = URL_RULES + [
        (r.choice(["allow", "block"]), ".".join(r.choices(["a", "b", "com", "org"], k=r.randint(1, 3))),
         r.choice(["", "/", "/d", "/de/", "/de/x", "/e/s/", "//"])) for _ in range(60)
    ]
    urls = URLS + [
        "http://" + ".".join(r.choices(["a", "b", "com", "org", ""], k=r.randint(1, 4))) + r.choice(["", "/", "/de/x", "/de/xy/z", "/e/s", "//de"])
        for _ in range(200)
    ]
    frame = spark.createDataFrame([(u, "clash") for u in urls], "url string, rule string")
    want = Counter(brute_verdict(u, rules) for u in urls)
    for limit in (10**6, 0):
        got = url_trie.judge(frame, rules, max_trie_bytes=limit).collect()
        assert Counter((x.host, x.path, x.rule, x.verdict) for x in got) == want


# ---- SimHash


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def brute_components(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in nodes}


def test_covering_masks_meet_every_pair_within_the_radius():
    r = random.Random(0)
    for radius in (1, 2, 3):
        masks = [m & (2**64 - 1) for m in simhash.covering_masks(radius)]
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not flips & m for m in masks)


def test_fingerprints_and_components(docs_of):
    base = prose(9, 400).split()
    near = []
    for k in range(40):
        words = list(base)
        words[10 * k % 400] = "new"
        near.append((100 + k, " ".join(words)))
    rows = TEXTS + near + [(4, OTHER)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    codes = {i: brute_fingerprint(t) for i, t in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{codes[i]:016x}") for i, _ in rows)
    nodes = sorted(set(codes.values()))
    group = brute_components(nodes, lambda a, b: (a ^ b).bit_count() <= 3)
    first = defaultdict(list)
    for i, code in codes.items():
        first[group[code]] += [i] if i is not None else []
    assert all(r.component_id == min(first[group[codes[r.doc_id]]]) for r in got)
    assert simhash.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("bucket", [16, 1024])
def test_links_lose_nothing_when_buckets_split(spark, bucket):
    """A dense ball of codes, a chain of steps of three, and codes far apart."""
    r = random.Random(3)
    centre, codes = r.getrandbits(64), set()
    for _ in range(250):
        codes.add(centre ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 5))))
    step = r.getrandbits(64)
    for k in range(60):
        step ^= sum(1 << b for b in r.sample(range(64), 3))
        codes.add(step)
    codes |= {r.getrandbits(64) for _ in range(100)}
    signed = sorted(c - 2**64 if c >> 63 else c for c in codes)
    frame = spark.createDataFrame([(c,) for c in signed], "code long")
    links = [(x.node, x.to) for x in simhash.links(frame, 3, bucket).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 and b < a for a, b in links)
    parent = {c: c for c in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = brute_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {c: root(c) for c in signed} == want


# ---- substring dedup


def brute_words(rows, window):
    seen, out = set(), []
    ordered = sorted({(-(2**63) if i is None else i, t) for i, t in rows}, key=lambda x: (x[0], x[1] or ""))
    cut = {}
    for i, t in ordered:
        words = WORD.findall(t or "")
        gone = set()
        for k in range(len(words) - window + 1):
            content = tuple(words[k : k + window])
            if content in seen:
                gone |= set(range(k, k + window))
            seen.add(content)
        cut[i, t] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    for i, t in rows:
        out.append((i, *cut[-(2**63) if i is None else i, t]))
    return Counter(out)


@pytest.mark.parametrize("bucket", [8 << 20, 60])
def test_repeated_words(docs_of, bucket):
    rows = TEXTS + [(4, OTHER), (30, "x\u00a0y " * 60), (31, prose(3, 30) + " " + prose(8, 25))]
    alone = prose(77, 60)  # nobody else has it: the repeated rows are one document and keep it
    rows += [(40, alone), (40, alone), (None, prose(78, 40)), (None, prose(78, 40)), (41, alone[:200] + " " + prose(79, 30))]
    got = superkmer.without_repeats(docs_of(rows, kept="clash"), 20, bucket).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_words(rows, 20)
    assert superkmer.without_repeats(docs_of([])).count() == 0


def test_hash_collisions_are_told_apart():
    ids = np.array([0, 1, 2, 0, 1, 2, 3, 0, 1, 2], np.int64)
    at = np.arange(8)
    want = np.array([tuple(ids[k : k + 3]) in {tuple(ids[j : j + 3]) for j in range(k)} for k in at])
    assert (superkmer._later_windows(ids, at, 3) == want).all()


# ---- suffix arrays


def brute_bytes(rows, window):
    places = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        places.update(raw[k : k + window] for k in range(len(raw) - window + 1))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - window + 1):
            if places[raw[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bucket", [3 << 20, 300])
def test_repeated_bytes(docs_of, bucket):
    rows = TEXTS + [(4, OTHER), (41, "z" * 201), (42, "xyz" * 80), (43, prose(50, 90)), (44, "Ü" + prose(50, 90)[3:])]
    got = suffix_array.without_repeats(docs_of(rows, n_spans="clash"), 200, bucket).collect()
    assert Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got
    ) == brute_bytes(rows, 200)
    assert suffix_array.without_repeats(docs_of([])).count() == 0


def test_corpus_order_is_sorted():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(40, 300))) for _ in range(8)] + [b"a" * 100, b"ab" * 60]
    place, string, offset = suffix_array.corpus_order(strings, 32)
    whole = [strings[s][o : o + 32] for s, o in zip(string.tolist(), offset.tolist(), strict=True)]
    assert whole == sorted(whole) and len(place) == sum(len(s) - 31 for s in strings)


def test_repeated_windows_random():
    r = random.Random(1)
    for trial in range(60):
        letters = r.choice([b"ab", b"a", bytes(range(97, 123)), bytes(range(256))])
        source = bytes(r.choice(letters) for _ in range(400))
        strings = set()
        for _ in range(r.randint(1, 6)):
            at = r.randint(0, 300)
            strings.add(bytes(r.choice(letters) for _ in range(r.randint(0, 30))) + source[at : at + r.randint(40, 100)])
        strings = [s for s in strings if len(s) >= 40]
        if not strings:
            continue
        seen = Counter(s[k : k + 40] for s in strings for k in range(len(s) - 39))
        want = {(n, k) for n, s in enumerate(strings) for k in range(len(s) - 39) if seen[s[k : k + 40]] > 1}
        got = suffix_array.repeated_windows(strings, 40)
        assert set(zip(*[x.tolist() for x in got], strict=True)) == want, trial


# ---- packing


def test_packing_is_whole_and_tight(docs_of):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = TEXTS + [(4, OTHER), (50, "<|endoftext|> it's 12 <|endoftext|>x"), (2**60 + 1, "Große ΣΑΣ é"), (51, "e\u0301 \u0301x")]
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.packed(packing.pieces(docs_of(rows), path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(packing.pieces(docs_of([]), path)).count() == 0


def test_sum_of_squares_is_near_the_bound():
    r = np.random.default_rng(0)
    lengths = np.minimum(2048, r.lognormal(6, 1, 4000).astype(np.int64) + 1)
    number, _ = packing.pack_longest_first(lengths)
    assert number.max() + 1 <= 1.01 * lengths.sum() / 2048
    assert packing.pack(np.array([2048, 2048, 1]))[0].tolist() == [0, 1, 2]


# ---- page text

PAGE = """<html><head><title>No</title><style>p{}</style></head><body>
<div id="cookie-banner">We use cookies. Accept them all to read on.</div><header><a href=/>Home</a> Site name</header>
<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="sidebar"><p>Most read: a long list of other stories that are not this one, with many words in it.</p></div>
<main><h1>Head &amp; line</h1><p>The first  paragraph has
 quite a few <b>bo</b>ld words &lt;3 in it, and an end.<p>Short one.</p>
<div class="ad-box">Buy our thing now, it is the best thing there has ever been in the world.</div>
<p>The last paragraph of the article, with <a href=x>one link</a> inside of many other words.</p>
<aside>Related: something else entirely, which is long enough to look like text.</aside>
<script>var a = "<p>no</p>";</script></main>
<form><p>Subscribe to our letter, please enter your address here.</p><input value=x></form>
<section id="comments"><p>First! This is a comment of a reader with plenty of words to say about it.</p></section>
<footer><p>&copy; 2024 The company. All rights reserved in all of the countries.</p></footer></body></html>"""


def test_page_text(spark):
    article = (
        "Head & line\nThe first paragraph has quite a few bold words <3 in it, and an end.\nShort one.\n"
        "The last paragraph of the article, with one link inside of many other words."
    )
    pages = [(1, PAGE), (2, None), (3, ""), (4, "<nav><a>x</a></nav>"), (5, "<![if x]><p>" + "Plain words of a page. " * 20), (1, PAGE)]
    frame = spark.createDataFrame([(i, h, "clash") for i, h in pages], "page_id int, html string, text string")
    got = mincut_html.extract(frame).select("page_id", "text", "n_chars").collect()
    want = {1: article, 2: "", 3: "", 4: "", 5: ("Plain words of a page. " * 20).strip()}
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(i, want[i], len(want[i])) for i, _ in pages]
    assert mincut_html.main_text("<p>" * 3000 + "word " * 100).startswith("word")


def test_parts_of_an_article_stay():
    lines = [f"Sentence number {k} of a paragraph that has quite a few words in it, as articles do." for k in range(5)]
    page = (
        f'<div class="legal"><p>{lines[0]}</p></div><article><header class="post-header"><h1>A headline</h1></header><p>{lines[1]}</p>'
        f'<div class="legal"><p>{lines[2]}</p></div><section class="reviews"><p>{lines[3]}</p></section>'
        f'<div class="ads"><p>{lines[4]}</p></div><section id="comments"><p>{lines[4]}</p></section></article>'
    )
    assert mincut_html.main_text(page) == "\n".join(["A headline", *lines[1:4]])


@pytest.mark.parametrize("opened", ["<span>", "<p><table><blockquote>", "<li><b>", "<a>"])
def test_deep_pages_cost_in_proportion(opened):
    def steps(n):
        seen = 0

        def count(frame, event, _):
            nonlocal seen
            seen += event == "line"
            return count

        sys.settrace(count)
        try:
            mincut_html.Blocks().feed(opened * n + "<p>Some words</p></i>" * n)
        finally:
            sys.settrace(None)
        return seen

    assert steps(800) < 2.5 * steps(400)


def test_minimum_cut_is_minimal():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 8)
        scores = [r.randint(-5, 5) for _ in range(n)]
        ties = [(k, k + 1, r.randint(0, 4)) for k in range(n - 1)] + [(0, n - 1, 1)] * (n > 2)
        cost = lambda keep: sum(abs(s) for s, k in zip(scores, keep, strict=True) if k != (s > 0)) + sum(  # noqa: B023, E731
            w for a, b, w in ties if keep[a] != keep[b]  # noqa: B023
        )
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert cost(mincut_html.min_cut([float(s) for s in scores], ties)) == best


# ---- sharding


def test_shards_are_near_equal_and_gapless(docs_of, tmp_path):
    rows = TEXTS + [(4, OTHER)] + [(1000 + k, prose(k, k % 40 + 1)) for k in range(600)]
    path = str(tmp_path / "maps")
    got = slots.shard(docs_of(rows, slot="clash"), 5, 512, path).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    size, places = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(r.size for r in got)  # one record of more than a shard's share stands alone
    assert max(size.values()) <= max(1.02 * sum(size.values()) / 5, largest + 100)
    assert max(size.values()) - largest < 100 and np.ptp(sorted(size.values())[:-1]) < 100
    assert slots.shard(docs_of([]), 3).count() == 0


def test_map_versions(spark, tmp_path):
    r = random.Random(0)
    loads = [r.randint(0, 100) for _ in range(256)]
    first = slots.SlotMap.balanced(loads, 4)
    loads[:40] = [5 * load for load in loads[:40]]
    second = first.rebalanced(loads)
    total = Counter()
    for slot, shard in enumerate(second.shard_of):
        total[shard] += loads[slot]
    assert max(total.values()) <= 1.03 * sum(loads) / 4
    grown = second.rebalanced(loads, shards=5)
    assert all(b == a or b == 4 for a, b in zip(second.shard_of, grown.shard_of, strict=True))
    assert 0.8 < sum(loads[s] for s, x in enumerate(grown.shard_of) if x == 4) / (sum(loads) / 5) < 1.05
    path = str(tmp_path / "maps")
    for version in (first, second, grown):
        slots.save(spark, version, [1] * 256, path)
    assert [x.shard for x in slots.load(spark, path, 2).orderBy("virtual_slot").collect()] == second.shard_of
    assert slots.load(spark, path).agg(F.max("version")).first()[0] == 3


# ---- language


def test_language_filters(spark, docs_of):
    r = random.Random(0)
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["çe", "oi", "ée", "ux"]}
    say = lambda lang, n: " ".join("".join(r.choices(sounds[lang], k=r.randint(1, 4))) for _ in range(n))
    rows = [(k, say(lang, 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)] + [(None, say("aa", 9), "aa"), (900, None, "aa"), (901, say("bb", 9), None)]
    model = language_id.learn(docs_of(rows))
    asked = docs_of([(k, say(lang, n), lang) for k, (lang, n) in enumerate([("aa", 3), ("bb", 500), ("cc", 2), ("aa", 90000)])], score="clash")
    assert [x.lang_pred for x in language_id.predict(asked, model).orderBy("doc_id").collect()] == ["aa", "bb", "cc", "aa"]
    odd = docs_of([(1, None), (2, ""), (3, "12 %!"), (4, "日本語")])
    got = [(x.lang_pred, x.score) for x in language_id.predict(odd, model).orderBy("doc_id").collect()]
    assert got == [("und", 0.0)] * 3 + [("aa", 0.0)]
    assert language_id.learn(docs_of([])) is None
    assert language_id.predict(odd, None).where("lang_pred = 'und'").count() == 4


def test_many_languages(spark, docs_of):
    letters = [chr(0x4E00 + k) for k in range(300)]
    rows = [(k, " ".join(letters[k % 150] * 3 + letters[150 + k % 150] for _ in range(5)), f"l{k % 150:03}") for k in range(300)]
    model = language_id.learn(docs_of(rows))
    assert model.cells.shape[0] == 3
    assert [language_id.judged(model, [t])[0][0] for _, t, _ in rows] == [lang for _, _, lang in rows]
    few = language_id.learn(docs_of(rows + [(900, rows[0][1], "l000")]), languages=1)
    assert few.languages == ["l000"]


def test_filter_counts_are_corrected():
    learned = {"x": np.arange(1, 3000, dtype=np.uint64), "y": np.arange(9001, 9100, dtype=np.uint64)}
    model = language_id.Model.build(learned, "x")
    assert model.chance[0] > model.chance[1] and (model.chance < 0.05).all()


# ---- decontamination


def brute_contaminated(rows, items):
    """Every item laid over every text at every shift, without seeds."""
    token = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, text in rows:
        d = token(text)
        for item, words in items:
            b = token(words)
            if len(b) < 5:
                out |= {(i, item)} if b and b == d else set()
                continue
            for shift in range(-len(b), len(d)):
                flags = [d[j + shift] == b[j] for j in range(len(b)) if 0 <= j + shift < len(d)]
                width = min(13, len(flags))
                if len(flags) >= min(10, len(b)) and any(sum(flags[j : j + width]) >= 0.8 * width for j in range(len(flags) - width + 1)):
                    out.add((i, item))
    return out


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_spaced_seeds(spark, docs_of, block):
    items = [(1, PASSAGE), (2, prose(60, 40)), (3, "too short"), (4, None), (5, "na " * 30), (1, PASSAGE)]
    changed = prose(60, 40).split()
    for k in range(5, 40, 8):
        changed[k] = "OTHER"
    rows = TEXTS + [(60, prose(61, 20) + " " + " ".join(changed).upper() + ", " + prose(62, 20)), (61, " ".join(prose(60, 40).split()[:8]))]
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id int, text string, doc_id string")
    rows = [(i, t) for i, t in rows if len(t or "") < 20000 or i == 15]
    got = spaced_seeds.contaminated(docs_of(rows), benchmark, block)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == brute_contaminated(rows, items)
    assert {(5, 1), (3, 1), (15, 1), (60, 2), (13, 5)} <= found and not {i for i, _ in found} & {4, 61, 12, None}
    assert spaced_seeds.contaminated(docs_of([]), benchmark).count() == 0
    assert spaced_seeds.contaminated(docs_of(rows), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("masks, width, changes", [(spaced_seeds.SEEDS, n, 2) for n in (10, 11, 12, 13)] + [(spaced_seeds.SHORT_SEEDS, n, 1) for n in (5, 6, 7, 8, 9)])
def test_every_accepted_substitution_leaves_a_seed(masks, width, changes):
    for changed in itertools.combinations(range(width), changes):
        assert any(
            all(bit == "0" or p + k not in changed for k, bit in enumerate(mask))
            for mask in masks for p in range(width - len(mask) + 1)
        ), changed


def test_spaced_seeds_against_a_search_without_seeds(spark, docs_of):
    long, short = prose(80, 300).split(), {n: prose(80 + n, n) for n in (1, 3, 4, 5, 7, 9, 10, 11, 12, 13)}
    items = [(n, text) for n, text in short.items()] + [(300, " ".join(long))]
    rows = []
    for phase in range(5):
        rows.append((phase, " ".join("OTHER" if k % 5 == phase else w for k, w in enumerate(long))))
    for n, text in short.items():
        words = text.split()
        for changes in (0, 1, 2, 3):
            for changed in itertools.combinations(range(n), changes):
                mixed = " ".join("OTHER" if k in changed else w for k, w in enumerate(words))
                rows.append((1000 + len(rows), f"before {mixed} after"))
        rows += [(1000 + len(rows), text.upper() + "."), (1000 + len(rows) + 1, " ".join(words[:-1]))]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    got = spaced_seeds.contaminated(docs_of(rows), benchmark)
    found = [(r.doc_id, r.item_id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_contaminated(rows, items)
    assert {(phase, 300) for phase in range(5)} <= set(found)


def test_texts_stay_where_they_are(spark, docs_of):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id int, text string")
    plan = spaced_seeds.contaminated(docs_of(TEXTS), benchmark)._jdf.queryExecution().optimizedPlan().toString()
    # One scan of the documents: hits carry their words, and no join brings whole texts to them.
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_tokenizer_path_is_outside_the_repository():
    assert "/root/repo" not in tokenizer_path()


def test_packing_takes_latin_letters_straight_to_the_merges():
    """Ids are those of the tokenizer, also where words are forgotten; words of letters do without its normalizer."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [
        "Été ÉTÉ, été. ñandú Straße ÀÖØÞ ÿÿ naïve! the the The, Word",
        "µg ªº été ΣΑΣ Ελλάς हिन्दी বাংলা 中文 don't 555-9635 a b × ÷ 가 İI <|endoftext|> Ω…",
        "Été the zqx; zqx ñ ñ? 25a0bc �",
    ] * 3
    want = [plain.encode(text, add_special_tokens=False).ids for text in texts]
    for remembered in (1, 4, 1000):
        known = packing.WordIds(path, remembered)
        assert [list(array("I", known.encode(text.encode().split()))) for text in texts] == want

    known = packing.WordIds(path)
    known._encoded = None
    assert list(array("I", known.encode("Ñandú était Straße".encode().split()))) == plain.encode("Ñandú était Straße", add_special_tokens=False).ids
