"""All queries of the library itself, with their SQL."""

from __future__ import annotations

from . import corpus_queries, planted


def library_queries() -> dict:
    return corpus_queries.QUERIES | planted.QUERIES


def library_sql() -> dict[str, str]:
    return corpus_queries.SQL | planted.SQL
