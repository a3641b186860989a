"""All queries of the catalogue."""

from __future__ import annotations

from tandemtext.plans import io_queries, metric_queries, report_queries, rule_queries, set_queries, text_queries

MODULES = (text_queries, metric_queries, rule_queries, set_queries, report_queries, io_queries)
QUERIES = {name: f for m in MODULES for name, f in m.R.queries.items()}
SQL = {name: sql for m in MODULES for name, sql in m.R.sql.items()}
