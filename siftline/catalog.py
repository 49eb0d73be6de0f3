"""All queries of the library with the SQL that gives the same rows."""

from __future__ import annotations

from siftline.plans import answer_queries, element_queries, evaluation_queries, graph_queries, more_queries, ranking_queries, relational_queries, source_queries, streaming_queries, text_queries, window_queries  # noqa: F401  they register
from siftline.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
