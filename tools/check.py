"""Check registered queries against their oracles: python tools/check.py [sf] [name part ...]."""

from __future__ import annotations

import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from oracle import TIMES, compare, connect  # noqa: E402

from assayer.core.session import local_session  # noqa: E402
from assayer.plans.catalog import oracle_sql, queries  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
parts = sys.argv[2:]
folder = f"/root/testdata/sf{sf}"
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
oracles = oracle_sql()
bad = 0
for name, fn in queries().items():
    if parts and not any(name.startswith(p) for p in parts):
        continue
    start = time.time()
    try:
        if name in oracles:
            problem, rows = compare(spark, con, folder, name, fn, oracles[name])
        else:
            problem, rows = "", len(fn(spark, folder).collect())
    except Exception as error:  # noqa: BLE001
        problem, rows = f"ERROR {type(error).__name__}: {str(error)[:400]}", -1
        if "-v" in parts:
            traceback.print_exc()
    kind = "oracle" if name in oracles else "rows"
    bad += bool(problem)
    print(f"{'FAIL' if problem else 'ok  '} {name:45s} {kind:6s} rows={rows:7d} {time.time() - start:6.1f}s spark={TIMES.get(name, 0):5.1f} {problem[:1500]}", flush=True)
print("failures:", bad)
