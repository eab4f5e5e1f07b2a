"""Every registered query against its SQL oracle, over whole tables at the smallest scale."""

import pytest
from oracle import compare, connect

from assayer.plans.catalog import oracle_sql, queries

ORACLES, QUERIES = oracle_sql(), queries()
# Without an oracle, a query must run and return rows; training is covered in test_model.
ROWS_ONLY = [n for n in QUERIES if n not in ORACLES and not n.startswith("mdl4")]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, folder, name):
    problem, _ = compare(spark, con, folder, name, QUERIES[name], ORACLES[name])
    assert not problem


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).limit(1).count() == 1
