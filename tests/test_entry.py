import sys

import pytest

sys.path.insert(0, "tests")
import __spark_entry__ as entry
from parity import rows_in_sql, rows_of, views
from vectrail.plans import QUERIES, SQL


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, small):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, small, name):
    con = views(small)
    assert rows_of(QUERIES[name](spark, small)) == rows_in_sql(con, SQL[name])
