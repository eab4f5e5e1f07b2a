"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.llm import (
    count_transducers,
    language_id,
    mincut_html,
    oph_fingerprints,
    packing,
    quality_rules,
    simhash,
    slots,
    spaced_seeds,
    spectrum_whitening,
    suffix_array,
    superkmer,
    url_trie,
)
from assayer.llm.common import documents, read_table

URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
SHARDS = 24
#: A file of the tokenizers library; any path the executors can read.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality_rules(spark, folder):
    labels = read_table(spark, folder, "labels")
    judged = quality_rules.judge(documents(spark, folder), labels)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op2_url_filters(spark, folder):
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    return url_trie.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_simhash(spark, folder):
    return simhash.near_duplicates(documents(spark, folder), shingle=3, radius=3)


def op4_substring_dedup(spark, folder):
    cut = superkmer.without_repeats(documents(spark, folder).select("doc_id", "text"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark, folder):
    cut = suffix_array.without_repeats(documents(spark, folder).select("doc_id", "text"), window=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark, folder):
    return packing.packed(packing.pieces(documents(spark, folder), tokenizer_path()))


def op7_html_extraction(spark, folder):
    return mincut_html.extract(read_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op8_sharding(spark, folder):
    placed = slots.shard(documents(spark, folder), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def held_out(doc_id):
    """A fifth of the ids, chosen by a checksum; an unknown id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def language_model(docs):
    return language_id.learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def op9_language_id(spark, folder):
    docs = documents(spark, folder)
    judged = language_id.predict(docs.select("doc_id", "text"), language_model(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark, folder):
    return spaced_seeds.contaminated(documents(spark, folder), read_table(spark, folder, "benchmark"))


def op11_document_fingerprints(spark, folder):
    found = oph_fingerprints.fingerprints(documents(spark, folder))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op12_phrase_collocations(spark, folder):
    return count_transducers.collocations(documents(spark, folder))


def op13_embedding_whitening(spark, folder):
    found = spectrum_whitening.whiten(read_table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_quality_rules, op2_url_filters, op3_simhash, op4_substring_dedup, op5_suffix_array_dedup, op6_packing,
        op7_html_extraction, op8_sharding, op9_language_id, op10_decontamination, op11_document_fingerprints,
        op12_phrase_collocations, op13_embedding_whitening,
    )
}

_FITS = " UNION ALL ".join(
    f"SELECT page_id, '{host}{path}' AS rule, '{action}' AS action, {host.count('.') + 1} * 10000 + {len(path)} AS depth FROM parts "
    f"WHERE (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    for action, host, path in URL_RULES
)

# Windows of 20 words in order of (document, start); all but the first of each content cover their words.
# Repeated rows are one document: it is judged once, and every row gets its result.
_REPEATS = r"""
    WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS no,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
               FROM (SELECT DISTINCT doc_id, text FROM documents)),
    word AS (SELECT no, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
    win AS (SELECT no, i, array_to_string(ws[i:i + 19], ' ') AS content
            FROM (SELECT no, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
    later AS (SELECT no, i FROM (SELECT no, i, row_number() OVER (PARTITION BY content ORDER BY no, i) AS nth FROM win) WHERE nth > 1),
    gone AS (SELECT DISTINCT no, unnest(range(i, i + 20)) AS i FROM later),
    kept AS (SELECT no, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (no, i) GROUP BY no)
    SELECT r.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents r JOIN d ON r.doc_id IS NOT DISTINCT FROM d.doc_id AND r.text IS NOT DISTINCT FROM d.text LEFT JOIN kept USING (no)"""


def _tokens_sql(text: str) -> str:
    plain = rf"regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    return f"list_filter(string_split({plain}, ' '), lambda t: t <> '')"


def _runs_sql(source: str, key: str, tokens: str, size: int, where: str = "true") -> str:
    """(key, place, words) of every run of ``size`` neighbouring words."""
    words = ", ".join(f"{tokens}[place + {k + 1}]" for k in range(size))
    return (
        f"SELECT {key}, place, [{words}] AS run FROM (SELECT {key}, {tokens}, unnest(range(0, len({tokens}) - {size - 1})) AS place "
        f"FROM {source} WHERE len({tokens}) >= {size} AND {where})"
    )


# No seeds here: two substitutions in 10 to 13 words leave three neighbouring words alone, one in 5 to 9 leaves two.
# Items are laid over texts wherever such words meet; the best sufficient overlap of a pair counts.
_LONG, _SHORT = spaced_seeds.LEAST, spaced_seeds.LEAST_SHORT
_OVERLAPS = f"""
    WITH d AS (SELECT doc_id, {_tokens_sql('text')} AS ds FROM documents),
    b AS (SELECT DISTINCT item_id, {_tokens_sql('text')} AS bs FROM benchmark),
    hit AS (SELECT DISTINCT x.doc_id, y.item_id, x.place - y.place AS shift
            FROM ({_runs_sql('d', 'doc_id', 'ds', 3)}) x JOIN ({_runs_sql('b', 'item_id', 'bs', 3, f'len(bs) >= {_LONG}')}) y USING (run)
            UNION SELECT DISTINCT x.doc_id, y.item_id, x.place - y.place AS shift
            FROM ({_runs_sql('d', 'doc_id', 'ds', 2)}) x JOIN ({_runs_sql('b', 'item_id', 'bs', 2, f'len(bs) >= {_SHORT} AND len(bs) < {_LONG}')}) y USING (run)
            UNION SELECT doc_id, item_id, 0 FROM d JOIN b ON ds = bs WHERE len(bs) BETWEEN 1 AND {_SHORT - 1}),
    laid AS (SELECT doc_id, item_id, greatest(shift, 0) AS doc_start, greatest(-shift, 0) AS item_start, ds, bs,
                    least(len(ds) - greatest(shift, 0), len(bs) - greatest(-shift, 0)) AS size
             FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
    flagged AS (SELECT *, list_transform(range(1, size + 1), lambda k: CAST(ds[doc_start + k] = bs[item_start + k] AS INTEGER)) AS f,
                       least(size, {spaced_seeds.STRETCH}) AS width FROM laid WHERE size >= least(len(bs), {_LONG})),
    checked AS (SELECT *, list_sum(f) AS overall FROM flagged
                WHERE list_max(list_transform(range(1, size - width + 2), lambda k: list_sum(f[k:k + width - 1]))) >= {spaced_seeds.AGREE} * width)
    SELECT doc_id, item_id, CAST(overall AS BIGINT) AS agreeing_words, CAST(len(bs) AS BIGINT) AS item_words,
           CAST(doc_start AS BIGINT) AS doc_start, CAST(item_start AS BIGINT) AS item_start
    FROM checked QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overall DESC, doc_start, item_start) = 1"""

# All phrases of one to five words are counted; lists of words keep their places.
_COLLOCATIONS = r"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang,
                          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
                   FROM documents),
    listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece),
    started AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed),
    gram AS (SELECT lang, unnest([ws[i:i + k] FOR k IN range(0, 5) IF i + k <= len(ws)]) AS g FROM started),
    f AS (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS a FROM gram GROUP BY lang, phrase),
    total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
    candidate AS (SELECT * FROM f WHERE a >= 100 AND len(g) >= 2),
    cut AS (SELECT c.lang, c.phrase, c.a, len(c.g) AS m, k, array_to_string(c.g[1:k], ' ') AS lp, array_to_string(c.g[k + 1:], ' ') AS rp
            FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidate) c),
    scored AS (SELECT c.*, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
               FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp JOIN total t ON t.lang = c.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_phrase AS (SELECT lang, a, array_to_string(g[s:e], ' ') AS phrase
               FROM (SELECT *, unnest(range(s + 1, len(g) + 1)) AS e FROM (SELECT *, unnest(range(1, len(g))) AS s FROM candidate)) WHERE e - s + 1 < len(g)),
    inside AS (SELECT DISTINCT b.lang, b.phrase FROM best b JOIN inner_phrase i ON i.lang = b.lang AND i.phrase = b.phrase WHERE 100 * i.a >= 100 * b.a)
    SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank, phrase, a, l, r, n, score
    FROM best ANTI JOIN inside USING (lang, phrase) QUALIFY rank <= 2000"""

ORACLES = {
    "op12_phrase_collocations": _COLLOCATIONS,
    "op4_substring_dedup": _REPEATS,
    "op10_decontamination": _OVERLAPS,
    "op2_url_filters": rf"""
        WITH cut AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h,
                            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
        fits AS ({_FITS}),
        best AS (SELECT page_id, arg_max(rule, depth) AS rule, arg_max(action, depth) AS action FROM fits GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)""",
}
