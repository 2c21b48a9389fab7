import os

import pytest

from semspan.plans import surfaces  # noqa: F401 - registers its queries
from semspan.plans.workload import ORACLES, QUERIES
from tests.oracle import connect, rows_of, rows_of_sql

FOLDER = os.environ.get("SEMSPAN_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == rows_of_sql(con, ORACLES[name])
