"""Named queries over the project's tables, with the SQL they are held against."""

from vectrail.plans import basic_queries, extra_queries, impute_queries, model_queries, more_queries, packed_queries, report_queries

_ALL = [model_queries, packed_queries, impute_queries, basic_queries, report_queries, more_queries, extra_queries]
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL = {k: s for m in _ALL for k, s in m.SQL.items()}
