"""All core queries and their SQL."""

from __future__ import annotations

from loomgrid.plans import general_queries, general_sql, ingest_queries, ingest_sql, reference_queries, reference_sql


def queries() -> dict:
    return reference_queries.QUERIES | ingest_queries.QUERIES | general_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return reference_sql.SQL | ingest_sql.SQL | general_sql.SQL
