"""All queries of the library's own operators, by name, with their SQL."""

from __future__ import annotations

from protomill.plans import item_queries, match_queries, metric_queries, more_queries, parser_queries, question_queries, record_queries, step_queries, text_queries  # noqa: F401  they register their queries
from protomill.plans.registry import QUERIES, SQL, Query

FLAGSHIP = "select_windows"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
