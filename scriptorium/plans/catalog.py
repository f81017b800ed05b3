"""All registered queries and SQL twins of the document operators."""

from __future__ import annotations

from . import registry, report_queries, review_queries, rule_queries, search_queries, serving_queries, text_queries  # noqa: F401  the modules register on import


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
