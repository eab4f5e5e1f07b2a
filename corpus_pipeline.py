"""A corpus from raw documents to packed training sequences.

Each stage works on everything its predecessor kept: ``STAGES`` lists (name,
function), a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written and read again as the next one's ``docs``. All but the last stage
return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import language_id, near_copies, packing, spaced_seeds, superkmer
from assayer.llm.common import documents, read_table, settle
from assayer.llm.queries import language_model, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of one Arrow batch: texts are long, and a batch is held several times on its way to Python and back.
BATCH_ROWS = 1000
#: Share of a text's n-grams that its language must know; prose has far more.
KNOWN_SHARE = 0.2


def _bounded(stage):
    """The stage, in a session whose Arrow batches have few rows."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@_bounded
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters, or in no known language, go."""
    judged = language_id.predict(docs.select(*COLUMNS), language_model(docs))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= KNOWN_SHARE)
    return judged.where(known).select(*COLUMNS)


@_bounded
def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, similarity 0.8 or more) one row stays.

    SimHash finds them, and MinHash bands those whose fingerprints lie further apart.
    It is the one with the smallest id, and of those the smallest text hash; rows
    without ids come last. Different texts under one id are different documents.
    """
    # Rows that agree in id and text are one; the number tells all others apart.
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row_id"))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    groups = near_copies.near_copies(rows.select("row_id", place.alias("doc_id"), "text"))
    firsts = groups.groupBy("component").agg(F.min(F.struct("doc_id", "row_id")).alias("first"))
    return rows.join(firsts.select("first.row_id"), "row_id", "left_semi").dropDuplicates(["row_id"]).select(*COLUMNS)


@_bounded
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a text of which nothing stays goes, others are left as they are."""
    cut = superkmer.without_repeats(docs.select(*COLUMNS), untouched=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}).select(*COLUMNS)


@_bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    key = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")]
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.struct(*[k.alias(f"k{n}") for n, k in enumerate(key)]))
    found = spaced_seeds.contaminated(keyed.select(F.col("row_key").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    leaked = found.select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(leaked, "row_key", "left_anti").select(*COLUMNS)


@_bounded
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and their place in it."""
    return packing.packed(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", keep_first_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Language models, fingerprints and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = documents(spark, sf_dir)
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = settle(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
