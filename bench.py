"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, optional).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayer.core.session import local_session  # noqa: E402
from assayer.plans.catalog import queries  # noqa: E402

HEADLINE = [
    "flagship_document_screening", "prj2_mask_personal_data", "prj3_personal_data_census", "cls1_split_sentences",
    "jn1_clauses_by_lexicon", "jn4_first_match", "agg1_risk_tiers", "agg3_confusion_by_language", "num6_numeric_claims",
    "ret1_tokens", "ret2_bm25", "win3_top_k", "win2_merge_spans", "ret3_cards_under_budget", "mdl1_model_tokens",
    "mdl7_batch_score", "snk1_upsert_saved_checks", "snk2_newest_fifty_per_user", "agg8_outcome_counters",
    "agg10_learning_progress", "set5_partition_and_leak_check", "dq2_repeated_texts", "str1_client_rate_batch",
    "str4_failure_streaks_batch",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cores, "assayer-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
