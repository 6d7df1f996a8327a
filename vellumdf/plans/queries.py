"""All queries of the core over the test tables, and their SQL."""

from __future__ import annotations

from . import library_queries, reference_queries, review_queries, table_queries, text_queries

QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES, **library_queries.QUERIES, **review_queries.QUERIES, **reference_queries.QUERIES}
ORACLE = {**text_queries.ORACLE, **table_queries.ORACLE, **library_queries.ORACLE, **review_queries.ORACLE, **reference_queries.ORACLE}
