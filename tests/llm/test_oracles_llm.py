"""The registered queries that have SQL, over whole tables at the smallest scale; the others return their rows."""

import pytest
from oracle import compare, connect

from assayer.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_simhash": "doc_id fingerprint component_id",
    "op5_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_html_extraction": "page_id url text n_chars",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_language_id": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, folder, name):
    problem, rows = compare(spark, connect(folder), folder, name, QUERIES[name], ORACLES[name])
    assert not problem and rows


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_contract(spark, folder, name):
    got = QUERIES[name](spark, folder)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    table = "pages" if name.startswith("op7") else "documents"
    rows = spark.read.parquet(f"{folder}/{table}.parquet").count()
    assert got.count() >= rows if name == "op6_packing" else got.count() == rows


def test_held_out_languages_are_right(spark, folder):
    got = QUERIES["op9_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = [r.lang == r.lang_pred for r in got.where("held_out").collect()]
    assert sum(right) >= 0.95 * len(right)


def test_every_native_plan_is_free_of_python(spark, folder):
    for name in ("op1_quality_rules", "op8_sharding", "op10_decontamination"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
