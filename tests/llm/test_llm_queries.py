import os

import pytest

from semspan.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, rows_of, rows_of_sql

FOLDER = os.environ.get("SEMSPAN_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == rows_of_sql(connect(FOLDER), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    QUERIES[name](spark, FOLDER).collect()
