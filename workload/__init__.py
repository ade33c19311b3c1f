"""The registered queries: one per operator, each with the SQL it must agree with."""

from __future__ import annotations

from . import diagnosing, grouping, hot, joining, loading, preparing, windowing
from .common import Query

QUERIES: dict[str, Query] = {}
for _part in (preparing, windowing, joining, grouping, loading, diagnosing, hot):
    _again = QUERIES.keys() & _part.QUERIES.keys()
    if _again:
        raise ValueError(f"Registered twice: {sorted(_again)}")
    QUERIES.update(_part.QUERIES)
