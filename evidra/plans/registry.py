"""All queries and their SQL, by name."""

from __future__ import annotations

from evidra.plans import layers, queries, sql

QUERIES = queries.QUERIES | layers.QUERIES
SQL: dict[str, str] = sql.SQL | layers.SQL
