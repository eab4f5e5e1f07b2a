"""Retrieval over documents and cards, contrast pairs, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.core.dims import dim
from assayer.core.session import read_table, settle, spread
from assayer.operators import retrieval as r
from assayer.operators import rules
from assayer.packs import library
from assayer.plans.catalog import query
from assayer.plans.oracle_parts import FINDINGS, M
from assayer.plans.retrieval_sql import CARDS, PAIRS, RETRIEVED, SOURCES, bm25_ctes, tokens_sql
from assayer.sources import messages

_DOCS = "(SELECT doc_id, text FROM documents)"
_ASKED = "(SELECT item_id AS q_id, text FROM benchmark)"
_SCORED = bm25_ctes(_ASKED, "documents")


def corpus(spark, folder):
    return spread(read_table(spark, folder, "documents").select("doc_id", "text"))


def asked(spark, folder):
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    return r.asked_tokens(items, "q_id")


def scores(spark, folder):
    postings = settle(r.index(corpus(spark, folder), asked(spark, folder)), "postings")
    return r.bm25(asked(spark, folder), postings, read_table(spark, folder, "documents"))


@query("ret1_tokens", f"SELECT doc_id, token, tf FROM ({tokens_sql('documents', 'doc_id')})")
def tokens(spark, folder):
    return r.tokens(corpus(spark, folder), "doc_id")


@query(
    "agg13_corpus_statistics",
    f"""WITH p AS ({tokens_sql('documents', 'doc_id')})
        SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY token""",
)
def corpus_statistics(spark, folder):
    return r.tokens(corpus(spark, folder), "doc_id").groupBy("token").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf")
    )


@query(
    "agg13_average_length",
    f"""SELECT count(*) AS n_docs, round(sum(coalesce(n, 0)) / count(*), 6) AS average FROM documents
        LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM ({tokens_sql('documents', 'doc_id')}) GROUP BY doc_id) USING (doc_id)""",
)
def average_length(spark, folder):
    from assayer.functions.text import nfkc, retrieval_tokens

    sizes = corpus(spark, folder).select(F.size(retrieval_tokens(nfkc(F.col("text")))).alias("n"))
    return sizes.agg(F.count("*").alias("n_docs"), F.round(F.sum("n") / F.count("*"), 6).alias("average"))


@query("ret2_bm25", f"WITH {_SCORED} SELECT q_id, doc_id, score FROM bm_score")
def bm25(spark, folder):
    return scores(spark, folder)


@query(
    "win3_top_k",
    f"""WITH {_SCORED} SELECT q_id, doc_id, score, CAST(rk AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rk FROM bm_score) WHERE rk <= 5""",
)
def top_k(spark, folder):
    postings = settle(r.index(corpus(spark, folder), asked(spark, folder)), "postings")
    return r.top_scores(asked(spark, folder), postings, read_table(spark, folder, "documents"), 5).select(
        "q_id", "doc_id", "score", "rank"
    )


@query(
    "win4_budget_fill",
    f"""WITH RECURSIVE {_SCORED},
        pool AS (SELECT q_id, doc_id, score, length(text) AS size, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rk
                 FROM bm_score JOIN documents USING (doc_id) WHERE length(text) + 2 <= 5000),
        pick AS (
          SELECT q_id, doc_id, score, 1 AS pick, size + 2 AS used, rk FROM pool WHERE rk = 1
          UNION ALL
          SELECT q_id, doc_id, score, pick, used, rk FROM (
            SELECT p.q_id, p.doc_id, p.score, k.pick + 1 AS pick, k.used + 1 + p.size AS used, p.rk,
                   row_number() OVER (PARTITION BY p.q_id ORDER BY p.rk) AS best
            FROM pick k JOIN pool p ON p.q_id = k.q_id AND p.rk > k.rk AND k.used + 1 + p.size <= 5000
            WHERE k.pick < 5) WHERE best = 1)
        SELECT q_id, doc_id, score, pick, used FROM pick""",
)
def budget_fill(spark, folder):
    sized = scores(spark, folder).join(
        corpus(spark, folder).select("doc_id", F.length("text").alias("size")), "doc_id"
    )
    return r.greedy_budget(sized, 5, 5000)


@query("ret3_cards_under_budget", f"WITH {M}, {RETRIEVED} SELECT msg_id, card_id, score, rank FROM retrieved")
def cards_under_budget(spark, folder):
    return r.retrieve_cards(messages.templated(spark, folder).select("msg_id", "text")).select(
        "msg_id", "card_id", "score", "rank"
    )


_PROMPT_CARD = "{'id': card_id, 'sourceId': source_id, 'title': title, 'passage': passage, 'url': url, 'reviewedAt': reviewed_at, 'categoryIds': category_ids}"


@query(
    "ret4_prompt_context",
    f"""WITH {M}, {RETRIEVED} SELECT msg_id, CAST(to_json(list({_PROMPT_CARD} ORDER BY rank)) AS VARCHAR) AS context FROM (
          SELECT r.msg_id, r.rank, c.card_id, c.source_id, c.title, c.passage, s.url, s.reviewed_at, c.category_ids
          FROM retrieved r JOIN cards c USING (card_id) JOIN sources s ON s.source_id = c.source_id) GROUP BY msg_id""",
)
def prompt_context(spark, folder):
    found = r.retrieve_cards(messages.templated(spark, folder).select("msg_id", "text"))
    cards = r.cards(spark).select("card_id", r.prompt_card().alias("card"))
    ranked = found.select("msg_id", "card_id", "rank").join(cards, "card_id")
    listed = ranked.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("rank", "card"))).alias("l"))
    return listed.select("msg_id", F.to_json(F.transform("l", lambda x: x["card"])).alias("context"))


_ELIGIBLE = """
said AS (SELECT DISTINCT msg_id, token FROM ({said})),
terms AS (SELECT DISTINCT pair_id, token FROM ({terms})),
overlap AS (SELECT msg_id, pair_id, count(*) AS overlap FROM said JOIN terms USING (token) GROUP BY ALL),
covered AS (
  SELECT msg_id, pair_id FROM (
    SELECT o.msg_id, o.pair_id, c.category, bool_or(list_contains(k.category_ids, c.category) AND list_contains(p.source_ids, k.source_id)) AS ok
    FROM overlap o JOIN pairs p USING (pair_id) JOIN (SELECT pair_id, unnest(category_ids) AS category FROM pairs) c USING (pair_id)
    JOIN retrieved k ON k.msg_id = o.msg_id GROUP BY ALL)
  GROUP BY ALL HAVING bool_and(ok)),
ranked AS (
  SELECT msg_id, pair_id, category_ids, overlap * 3 + CASE WHEN language = preferred THEN 1 ELSE 0 END AS score
  FROM (SELECT *, coalesce(script, CASE WHEN base = 'en' THEN 'en' ELSE base || '-Latn' END) AS preferred
        FROM overlap SEMI JOIN covered USING (msg_id, pair_id) JOIN pairs USING (pair_id)
        JOIN (SELECT msg_id, string_split(lang, '-')[1] AS base,
                     CASE WHEN regexp_matches(text, '\\p{{Devanagari}}') THEN 'hi' WHEN regexp_matches(text, '\\p{{Bengali}}') THEN 'bn' END AS script FROM m) USING (msg_id))
  WHERE CASE WHEN script IS NULL THEN language NOT IN ('hi', 'bn') ELSE language = script END)""".format(
    said=tokens_sql("m", "msg_id"),
    terms=tokens_sql("(SELECT pair_id, array_to_string(terms, ' ') AS text FROM pairs)", "pair_id"),
)
_PAIRS = f"WITH {M}, {RETRIEVED}, {PAIRS}, {_ELIGIBLE}"


def _pairs(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text", "lang")
    return r.rank_pairs(m, r.retrieve_cards(m.select("msg_id", "text")))


@query("ret5_rank_contrast_pairs", f"{_PAIRS} SELECT msg_id, pair_id, score FROM ranked")
def rank_pairs(spark, folder):
    return _pairs(spark, folder).select("msg_id", "pair_id", "score")


@query("jn14_compatible_pairs", f"{_PAIRS} SELECT pair_id, count(*) AS n_messages FROM covered GROUP BY pair_id")
def compatible_pairs(spark, folder):
    """Pairs whose every category has a retrieved card of a cited source (script not yet considered)."""
    m = messages.templated(spark, folder).select("msg_id", "text", "lang")
    shown = r.retrieve_cards(m.select("msg_id", "text"))
    pairs = dim(spark, library.PAIR_COLUMNS, library.CONTRAST_PAIRS)
    wanted = pairs.select("pair_id", "source_ids", F.size("category_ids").alias("n"), F.explode("category_ids").alias("category"))
    terms = r.tokens(pairs.select("pair_id", F.array_join("terms", " ").alias("text")), "pair_id").select("pair_id", "token")
    said = r.asked_tokens(m, "msg_id")
    shared = said.join(terms, "token").select("msg_id", "pair_id").distinct()
    offered = shown.select("msg_id", "source_id", F.explode("category_ids").alias("category"))
    met = wanted.join(offered, "category").where(F.array_contains("source_ids", F.col("source_id")))
    full = met.groupBy("msg_id", "pair_id", "n").agg(F.count_distinct("category").alias("met")).where("met = n")
    return full.join(shared, ["msg_id", "pair_id"], "left_semi").groupBy("pair_id").agg(F.count("*").alias("n_messages"))


@query(
    "win5_diverse_pairs",
    f"""{_PAIRS},
        pool AS (SELECT r.msg_id, r.pair_id, r.category_ids, length(CAST(to_json({{'pair_id': p.pair_id, 'language': p.language,
                   'category_ids': p.category_ids, 'positive': p.positive, 'caution': p.caution}}) AS VARCHAR)) AS size,
                   row_number() OVER (PARTITION BY r.msg_id ORDER BY r.score DESC, r.pair_id) AS rk FROM ranked r JOIN pairs p USING (pair_id)),
        one AS (SELECT msg_id, arg_min(pair_id, rk) AS pair_id, arg_min(category_ids, rk) AS category_ids, arg_min(size, rk) AS size, min(rk) AS rk
                FROM pool WHERE size + 2 <= {r.PAIR_BUDGET} GROUP BY msg_id),
        two AS (SELECT p.msg_id, arg_min(p.pair_id, p.rk) AS pair_id FROM one o JOIN pool p ON p.msg_id = o.msg_id AND p.rk > o.rk
                WHERE NOT list_has_any(o.category_ids, p.category_ids) AND o.size + 3 + p.size <= {r.PAIR_BUDGET} GROUP BY p.msg_id)
        SELECT msg_id, 1 AS rank, pair_id FROM one UNION ALL SELECT msg_id, 2, pair_id FROM two""",
)
def diverse_pairs(spark, folder):
    return r.choose_pairs(_pairs(spark, folder))


@query(
    "ret6_guidance_coverage",
    f"""WITH {M}, {RETRIEVED} SELECT lang, count(*) AS n, count(*) FILTER (n_cards > 0) AS n_any,
               count(*) FILTER (applicable) AS n_applicable, round(avg(CASE WHEN n_cards > 0 THEN 1.0 ELSE 0 END), 6) AS share_any
        FROM (SELECT m.lang, count(k.card_id) AS n_cards, coalesce(bool_or(list_contains(k.category_ids, m.theme)), false) AS applicable
              FROM m LEFT JOIN retrieved k USING (msg_id) GROUP BY m.msg_id, m.lang) GROUP BY lang""",
)
def guidance_coverage(spark, folder):
    m = messages.templated(spark, folder).select("msg_id", "text", "lang", "theme")
    shown = r.retrieve_cards(m.select("msg_id", "text")).join(m.select("msg_id", "theme"), "msg_id")
    per = shown.groupBy("msg_id").agg(
        F.count("*").alias("n_cards"), F.bool_or(F.array_contains("category_ids", F.col("theme"))).alias("applicable")
    )
    return m.join(per, "msg_id", "left").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_cards") > 0).alias("n_any"),
        F.count_if("applicable").alias("n_applicable"),
        F.round(F.avg(F.when(F.col("n_cards") > 0, 1.0).otherwise(0.0)), 6).alias("share_any"),
    )


@query(
    "ret7_corpus_coverage",
    f"""WITH {FINDINGS}, {CARDS}, {SOURCES},
        cats AS (SELECT DISTINCT unnest(category_ids) AS category FROM cards),
        used AS (SELECT rule_id AS item, count(*) AS n FROM f GROUP BY rule_id),
        cited AS (SELECT source_id AS item, count(*) AS n FROM f JOIN (SELECT rule_id, unnest(source_ids) AS source_id FROM ({rules.rules_dim_sql()})) USING (rule_id) GROUP BY source_id)
        SELECT 'category without card' AS gap, item, n FROM used WHERE item NOT IN (SELECT category FROM cats)
        UNION ALL SELECT 'source without card', item, n FROM cited WHERE item NOT IN (SELECT source_id FROM cards)
        UNION ALL SELECT 'source never cited', source_id, 0 FROM sources WHERE source_id NOT IN (SELECT item FROM cited)
        UNION ALL SELECT 'category never found', category, 0 FROM cats WHERE category NOT IN (SELECT item FROM used)""",
)
def corpus_coverage(spark, folder):
    """Guidance gaps seen from the findings: what messages raise, against what cards cover."""
    found = rules.findings(messages.templated(spark, folder).select("msg_id", "text"), with_mask=False)
    used = settle(found.groupBy(F.col("rule_id").alias("item")).agg(F.count("*").alias("n")), "used-rules")
    cards = r.cards(spark)
    cats = cards.select(F.explode("category_ids").alias("item")).distinct()
    sources = dim(spark, library.SOURCE_COLUMNS, library.SOURCES).select(F.col("source_id").alias("item"))
    rule_sources = rules.rules_dim(spark).select(F.col("rule_id").alias("item"), F.explode("source_ids").alias("source_id"))
    cited = used.join(rule_sources, "item").groupBy(F.col("source_id").alias("item")).agg(F.sum("n").alias("n"))
    covered = cards.select(F.col("source_id").alias("item")).distinct()

    def gap(name, left, right):
        n = F.col("n") if "n" in left.columns else F.lit(0).cast("bigint")
        return left.join(right.select("item"), "item", "left_anti").select(F.lit(name).alias("gap"), "item", n.alias("n"))

    return (
        gap("category without card", used, cats)
        .unionByName(gap("source without card", cited, covered))
        .unionByName(gap("source never cited", sources, cited))
        .unionByName(gap("category never found", cats, used))
    )
