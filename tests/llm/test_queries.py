import sys

import pytest

sys.path.insert(0, "tests")
from parity import rows_in_sql, rows_of, views
from vectrail.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == rows_in_sql(views(small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    if name == "p8_ids":
        pytest.importorskip("public_tokenizers")
    df = QUERIES[name](spark, small)
    n = df.count()
    assert n == df.distinct().count()
    assert n > 0
