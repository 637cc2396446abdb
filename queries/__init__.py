"""Queries over the given tables, each with the SQL it must agree with."""

from queries import (  # noqa: F401
    aggregation,
    changes,
    checks,
    filters,
    incremental,
    joins,
    metrics,
    projection,
    scalars,
    shop,
    staging,
    unions,
)
from queries.base import REGISTRY

__all__ = ["REGISTRY"]
