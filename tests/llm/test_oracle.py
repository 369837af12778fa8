"""The queries that SQL can express, against DuckDB on the smallest tables."""

import os
import sys
from types import SimpleNamespace

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(
    os.path.abspath(__file__)))), "tools"))

from check_queries import compare, duck  # noqa: E402
from ledgerlens.llm.queries import llm_queries, llm_sql  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_matches_oracle(spark, con, name):
    query = SimpleNamespace(run=llm_queries()[name], sql=llm_sql()[name])
    assert compare(spark, con, name, query, SF)["status"] == "ok"
