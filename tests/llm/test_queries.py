import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n, q in entry.queries().items() if q.__module__.startswith("quarryline.llm") and n not in entry.oracle_sql())
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_every_query_runs(spark, name):
    found = entry.queries()[name](spark, DATA)
    assert found.columns and (found.limit(1).count() == 1 or name.startswith("p1_"))
