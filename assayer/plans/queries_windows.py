"""Windows, spans and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.dims import sql_literal as q
from assayer.core.regex import positions
from assayer.core.session import read_table
from assayer.operators import clauses as c
from assayer.operators import retrieval, spans
from assayer.plans.catalog import query
from assayer.plans.retrieval_sql import tokens_sql
from assayer.sources import messages

_DOCS = "(SELECT doc_id AS msg_id, text FROM documents)"


@query(
    "win1_adjacent_clauses",
    f"""SELECT msg_id, clause_no, coalesce(lag(length(clause)) OVER w, 0) AS before, length(clause) AS here, coalesce(lead(length(clause)) OVER w, 0) AS after
        FROM ({c.clauses_sql(_DOCS, conjunctions=False)}) WINDOW w AS (PARTITION BY msg_id ORDER BY clause_no)""",
)
def adjacent_clauses(spark, folder):
    """Clause lengths with both neighbours; neighbours are read from the message's own array."""
    sizes = F.transform(c.clause_array(F.col("text"), False), lambda x: F.length(x["clause"]))
    docs = messages.documents(spark, folder).select("msg_id", sizes.alias("n"))
    return docs.select("msg_id", "n", F.posexplode("n").alias("clause_no", "here")).select(
        "msg_id", "clause_no", F.coalesce(F.get("n", F.col("clause_no") - 1), F.lit(0)).alias("before"), "here",
        F.coalesce(F.get("n", F.col("clause_no") + 1), F.lit(0)).alias("after"),
    )


_SPAN_PATTERNS = ("(?i)the [a-z]+", "[a-z]+ion[a-z]*", r"[.,] ?[A-Za-z]+")


def _positions_sql(pattern: str) -> str:
    return f"""SELECT msg_id, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY msg_id ORDER BY ord) - length(hit) AS BIGINT) AS s, length(hit) AS n
      FROM (SELECT msg_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS ord
            FROM (SELECT msg_id, regexp_extract_all(text, {q(pattern)}) AS hits, regexp_split_to_array(text, {q(pattern)}) AS gaps FROM {_DOCS}))"""


_SPANS = " UNION ALL ".join(f"SELECT msg_id, s, s + n AS e FROM ({_positions_sql(p)})" for p in _SPAN_PATTERNS)


def _merge_sql(mode: str, op: str) -> str:
    return f"""SELECT '{mode}' AS mode, msg_id, min(s) AS start, max(e) AS "end" FROM (
        SELECT *, sum(CASE WHEN coalesce(s {op} reach, true) THEN 1 ELSE 0 END) OVER (PARTITION BY msg_id ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, max(e) OVER (PARTITION BY msg_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp))
      GROUP BY msg_id, island"""


@query("win2_merge_spans", f"WITH sp AS MATERIALIZED ({_SPANS}) {_merge_sql('overlapping', '>=')} UNION ALL {_merge_sql('touching', '>')}")
def merge_spans(spark, folder):
    text = F.col("text")
    found = F.concat(*[
        F.transform(positions(text, p), lambda m: F.struct(m["pos"].alias("start"), (m["pos"] + F.length(m["hit"])).alias("end")))
        for p in _SPAN_PATTERNS
    ])
    docs = messages.documents(spark, folder).select("msg_id", found.alias("spans"))
    both = F.array(
        F.struct(F.lit("overlapping").alias("mode"), spans.merge_spans(F.col("spans"), False).alias("m")),
        F.struct(F.lit("touching").alias("mode"), spans.merge_spans(F.col("spans"), True).alias("m")),
    )
    return docs.select("msg_id", F.explode(both).alias("b")).select("b.mode", "msg_id", F.explode("b.m").alias("s")).select(
        "mode", "msg_id", "s.start", "s.end"
    )


_SENTENCES = c.clauses_sql(_DOCS, conjunctions=False)
_SCORE = "length(clause) - length(replace(replace(clause, 't', ''), 'e', ''))"


@query(
    "win6_strongest_sentence",
    f"""SELECT msg_id, clause_no, score, substr(part, 1, 300) AS excerpt FROM (
        SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY whole, score DESC, clause_no) AS rk FROM (
          SELECT msg_id, clause_no, trim(clause, ' ' || chr(10)) AS part, {_SCORE} AS score, false AS whole FROM ({_SENTENCES})
          WHERE length(trim(clause, ' ' || chr(10))) >= 6
          UNION ALL SELECT msg_id, 0, trim(text, ' ' || chr(10)), {_SCORE.replace('clause', 'text')}, true FROM {_DOCS})) WHERE rk = 1""",
)
def strongest_sentence(spark, folder):
    """The highest-scoring sentence of a message, first on ties; any sentence score fits in.

    A message without a sentence of six characters is judged as a whole.
    """
    docs = messages.documents(spark, folder).select("msg_id", "text", c.clause_array(F.col("text"), False).alias("cl"))

    def rate(clause, i):
        bare = F.replace(F.replace(clause, F.lit("t"), F.lit("")), F.lit("e"), F.lit(""))
        part = F.trim(clause, F.lit(" \n"))
        return F.struct((F.length(bare) - F.length(clause)).alias("minus"), i.alias("clause_no"), part.alias("part"))

    rated = F.filter(F.transform("cl", lambda x, i: rate(x["clause"], i)), lambda s: F.length(s["part"]) >= 6)
    best = docs.select("msg_id", F.coalesce(F.array_min(rated), rate(F.col("text"), F.lit(0))).alias("b"))
    return best.select("msg_id", "b.clause_no", (-F.col("b.minus")).alias("score"), F.substring("b.part", 1, 300).alias("excerpt"))


_FIRST = "regexp_extract(text, '[^ ]+ ')"


@query(
    "win7_every_occurrence",
    f"""SELECT msg_id, excerpt, CAST(at_n AS INTEGER) AS n, pos FROM (
        SELECT msg_id, excerpt, at_n, CAST(sum(length(gap)) OVER (PARTITION BY msg_id ORDER BY at_n) + (at_n - 1) * length(excerpt) AS BIGINT) AS pos
        FROM (SELECT msg_id, excerpt, unnest(gaps[1:len(gaps) - 1]) AS gap, generate_subscripts(gaps[1:len(gaps) - 1], 1) AS at_n
              FROM (SELECT msg_id, excerpt, string_split(text, excerpt) AS gaps FROM (SELECT msg_id, text, {_FIRST} AS excerpt FROM {_DOCS}) WHERE excerpt <> '')))""",
)
def every_occurrence(spark, folder):
    """Offsets of each document's first word with its space, wherever it occurs again."""
    docs = messages.documents(spark, folder).select("msg_id", "text", F.regexp_extract("text", "[^ ]+ ", 0).alias("excerpt"))
    found = docs.select("msg_id", "excerpt", F.posexplode(spans.occurrences(F.col("text"), F.col("excerpt"))).alias("n", "pos"))
    return found.select("msg_id", "excerpt", (F.col("n") + 1).alias("n"), "pos")


# --- set operations -----------------------------------------------------------------


@query(
    "set1_union_sources",
    """SELECT fixture, grp, train, count(*) AS n FROM (
        SELECT 'documents' AS fixture, source AS grp, true AS train FROM documents
        UNION ALL SELECT 'conversations', role, false FROM conversations) GROUP BY ALL""",
)
def union_sources(spark, folder):
    docs = read_table(spark, folder, "documents").select(
        F.lit("documents").alias("fixture"), F.col("source").alias("grp"), F.lit(True).alias("train")
    )
    turns = read_table(spark, folder, "conversations").select(
        F.lit("conversations").alias("fixture"), F.col("role").alias("grp"), F.lit(False).alias("train")
    )
    return docs.unionByName(turns).groupBy("fixture", "grp", "train").agg(F.count("*").alias("n"))


@query(
    "set2_last_value_first_place",
    """SELECT user_id, event_id % 50 AS key, min(event_id) AS first_place, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL""",
)
def last_value_first_place(spark, folder):
    events = read_table(spark, folder, "events")
    return events.groupBy("user_id", (F.col("event_id") % 50).alias("key")).agg(
        F.min("event_id").alias("first_place"), F.max_by("value", "event_id").alias("last_value")
    )


@query(
    "set4_term_overlap",
    f"""WITH a AS ({tokens_sql('benchmark', 'item_id')}), b AS ({tokens_sql('documents', 'doc_id')})
        SELECT item_id, doc_id, count(*) AS overlap FROM a JOIN b USING (token) GROUP BY ALL""",
)
def term_overlap(spark, folder):
    items = retrieval.tokens(read_table(spark, folder, "benchmark"), "item_id").select("item_id", "token")
    docs = messages.documents(spark, folder).withColumnRenamed("msg_id", "doc_id")
    said = retrieval.index(docs.select("doc_id", "text")).select("doc_id", "token")
    return said.join(items, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))


@query(
    "set5_partition_and_leak_check",
    """SELECT part, count(*) AS n, count(*) FILTER (shared) AS n_shared FROM (
        SELECT part, h IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AND part <> 'train' AS shared FROM (
          SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'train' ELSE 'evaluation only' END AS part, sha256(text) AS h FROM documents
          UNION ALL SELECT 'held out', sha256(text) FROM benchmark)) GROUP BY part""",
)
def partition_and_leak_check(spark, folder):
    """Rows per partition and how many outside training share a training text exactly.

    Texts meet as digests. Training digests are made distinct by a partial
    aggregate first, so one heavily copied text cannot fan out.
    """
    labelled = read_table(spark, folder, "labels").select("doc_id").withColumn("labelled", F.lit(True))
    docs = read_table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(labelled, "doc_id", "left")
    parts = docs.select(F.when(F.col("labelled"), "train").otherwise("evaluation only").alias("part"), "h").unionByName(
        read_table(spark, folder, "benchmark").select(F.lit("held out").alias("part"), F.sha2("text", 256).alias("h"))
    )
    counted = parts.groupBy("part", "h").agg(F.count("*").alias("n"))
    trained = counted.where("part = 'train'").select("h", F.lit(True).alias("known"))
    joined = counted.join(trained, "h", "left")
    shared = F.coalesce("known", F.lit(False)) & (F.col("part") != "train")
    return joined.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.when(shared, F.col("n")).otherwise(0)).alias("n_shared"))
