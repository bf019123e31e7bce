"""All queries over the reference's operators, with their SQL."""

from __future__ import annotations

from tidemark.plans import evidence, reference, relations

__all__ = ["QUERIES", "SQL", "evidence", "relations"]
QUERIES, SQL = reference.QUERIES, reference.SQL
