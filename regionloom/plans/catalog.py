"""All registered queries."""

from regionloom.plans import (  # noqa: F401
    queries_columns,
    queries_models,
    queries_places,
    queries_statistics,
)
from regionloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
