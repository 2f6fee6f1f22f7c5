"""All registered queries and their SQL."""

from __future__ import annotations

from tidemark.plans import evidence, series_queries, stream_queries, study_queries, text_queries  # noqa: F401  they register their queries
from tidemark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
