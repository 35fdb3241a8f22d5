"""The registered queries with an SQL twin, on the smallest tables."""

import pytest

from clinprep.llm.queries import ORACLES, QUERIES
from tests.verify import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    problem, rows = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None and rows > 0


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
