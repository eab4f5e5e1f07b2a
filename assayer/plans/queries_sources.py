"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.core.session import read_table, shared_dir, spread
from assayer.functions import text as t
from assayer.plans.catalog import query
from assayer.sources import messages, saved
from assayer.streaming import jobs

_TRIM = "regexp_replace({}, '^[\\s\\x{{A0}}\\x{{FEFF}}\\p{{Zs}}]+|[\\s\\x{{A0}}\\x{{FEFF}}\\p{{Zs}}]+$', '', 'g')"


@query(
    "src1_load_labelled_messages",
    """SELECT doc_id AS msg_id, source, lang, quality, toxic, text FROM documents JOIN labels USING (doc_id)""",
)
def load_labelled(spark, folder):
    labels = read_table(spark, folder, "labels").select(F.col("doc_id").alias("msg_id"), "quality", "toxic")
    return messages.documents(spark, folder).join(labels, "msg_id").select(
        "msg_id", "source", "lang", "quality", "toxic", "text"
    )


@query(
    "src1_json_message_sets",
    """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, text, quality = 0 AS label FROM documents JOIN labels USING (doc_id)""",
)
def json_message_sets(spark, folder):
    """Labelled documents written as JSON sets of all four root shapes, their label in three ways, and read back."""
    labels = read_table(spark, folder, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rows = read_table(spark, folder, "documents").join(labels, "doc_id")
    way = F.pmod(F.col("doc_id"), F.lit(3))
    items = rows.select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"), "text",
        F.when(way == 0, F.col("bad")).alias("expectAttention"), F.when(way == 1, F.col("bad")).alias("expectedAttention"),
        F.when(way == 2, F.when(F.col("bad"), "strong-scam-signals").otherwise("no-signals")).alias("riskIntent"),
    )
    path = shared_dir(spark, "json-sets")
    messages.write_json_sets(items, path)
    read = messages.json_messages(spark, path, whole_files=False)
    return read.select("id", "language", "text", messages.harmonised_label(read).alias("label"))


@query(
    "src2_harmonise_labels",
    """SELECT 'contrast' AS origin, doc_id, quality = 0 AS label FROM labels
       UNION ALL SELECT 'review', doc_id, toxic = 1 FROM labels""",
)
def harmonise_labels(spark, folder):
    labels = read_table(spark, folder, "labels")
    contrast = labels.select(
        F.lit("contrast").alias("origin"), "doc_id", (F.col("quality") == 0).alias("expectAttention")
    )
    review = labels.select(
        F.lit("review").alias("origin"), "doc_id",
        F.when(F.col("toxic") == 1, "scam").otherwise("benign").alias("group"), F.lit(True).alias("scored"),
    )
    unlabelled = read_table(spark, folder, "documents").select(F.lit("plain").alias("origin"), "doc_id")
    union = contrast.unionByName(review, allowMissingColumns=True).unionByName(unlabelled, allowMissingColumns=True)
    return (
        union.withColumn("label", messages.harmonised_label(union)).where("label IS NOT NULL")
        .select("origin", "doc_id", "label")
    )


@query(
    "src3_assemble_conversation",
    f"""SELECT conv_id, n_parts, total, substr(whole, 1, 6000) AS text, total > 6000 AS truncated FROM (
        SELECT conv_id, count(*) AS n_parts, string_agg(part, chr(10) || chr(10) ORDER BY turn) AS whole,
               CAST(sum(length(part)) + 2 * (count(*) - 1) AS BIGINT) AS total
        FROM (SELECT conv_id, part, min(turn) AS turn FROM (
                SELECT conv_id, turn, {_TRIM.format("replace(text, chr(0), '')")} AS part FROM conversations)
              WHERE part <> '' GROUP BY ALL) GROUP BY conv_id)""",
)
def assemble_conversation(spark, folder):
    return messages.conversations(spark, folder)


@query(
    "src4_stream_intake",
    f"""SELECT msg_id, lang, substr({t.masked_sql('whole')}, 1, 6000) AS text, length(whole) AS n_chars,
               CASE WHEN length(whole) < 12 THEN 'too short' WHEN length(whole) > 6000 THEN 'too long' ELSE 'kept' END AS status
        FROM (SELECT doc_id AS msg_id, lang, {_TRIM.format('nfc_normalize(text)')} AS whole FROM documents)""",
)
def stream_intake(spark, folder):
    return jobs.intake(spark, folder)


_CANON = "to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})"


@query("src5_row_digest", f"SELECT doc_id, sha256({_CANON}) AS digest FROM documents")
def row_digest(spark, folder):
    return messages.row_digests(spread(read_table(spark, folder, "documents")), "doc_id")


@query(
    "src5_dataset_digest",
    f"""SELECT source, count(*) AS n_rows, bit_xor(CAST('0x' || substr(sha256({_CANON}), 1, 15) AS BIGINT)) AS digest
        FROM documents GROUP BY source""",
)
def dataset_digest(spark, folder):
    docs = spread(read_table(spark, folder, "documents"))
    return (
        messages.row_digests(docs, "source")
        .groupBy("source")
        .agg(
            F.count("*").alias("n_rows"),
            F.bit_xor(F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")).alias("digest"),
        )
    )


_VERSIONS = """SELECT user_id, event_id % 200 AS check_id, ts, event_id, value,
                      CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS priority FROM events"""


@query(
    "snk1_upsert_saved_checks",
    f"""SELECT user_id, check_id, priority, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, check_id ORDER BY priority DESC, ts DESC, event_id DESC) AS rk
        FROM ({_VERSIONS})) WHERE rk = 1""",
)
def upsert_saved(spark, folder):
    events = read_table(spark, folder, "events")
    checks = events.select(
        "user_id", (F.col("event_id") % 200).alias("check_id"), F.col("ts").alias("saved_at"), "event_id", "value",
        "event_type",
    )
    incoming = checks.where(F.col("event_type").isin("purchase", "click")).drop("event_type")
    stored = checks.where(~F.col("event_type").isin("purchase", "click")).drop("event_type")
    path = shared_dir(spark, "saved-checks")
    saved.create(stored, path)
    return saved.merge(path, incoming).select("user_id", "check_id", "priority", "event_id", "value")


@query(
    "snk2_newest_fifty_per_user",
    """SELECT user_id, event_id, CAST(rk AS INTEGER) AS rank FROM (
       SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rk FROM events) WHERE rk <= 50""",
)
def newest_fifty(spark, folder):
    events = read_table(spark, folder, "events").select("user_id", "event_id", F.col("ts").alias("saved_at"))
    return saved.newest(events, 50).select("user_id", "event_id", "rank")


@query(
    "snk3_split_oversize_rows",
    """SELECT doc_id, n_bytes, n_bytes <= 65536 AND complete AS accepted FROM (
       SELECT doc_id, octet_length(encode(to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars}))) AS n_bytes,
              doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AS complete FROM documents)""",
)
def split_oversize(spark, folder):
    docs = spread(read_table(spark, folder, "documents"))
    return saved.judged(docs, ["doc_id", "text", "lang", "source"]).select("doc_id", "n_bytes", "accepted")
