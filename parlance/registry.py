"""Every query of the analytics library by name, and its SQL."""

from __future__ import annotations

from parlance.plans import event_queries, index_queries  # noqa: F401  (they add their queries)
from parlance.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
