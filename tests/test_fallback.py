import os

import pytest

from semspan.backends import ScriptedBackend
from semspan.plans import workload
from semspan.runtime import read_table

FOLDER = os.environ.get("SEMSPAN_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_map_fallback_asks_the_model_where_the_function_fails(spark, monkeypatch):
    monkeypatch.setattr(workload, "BACKEND", ScriptedBackend(default="<both>asked 7</both>"))
    got = {r["p_partkey"]: r["name"] for r in workload.map_fallback(spark, FOLDER).collect()}
    part = read_table(spark, FOLDER, "part").collect()
    assert got == {r["p_partkey"]: "asked" if r["p_size"] <= 25 else r["p_name"].upper() for r in part}
