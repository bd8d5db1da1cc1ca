"""The catalogue of registered queries: importing the modules registers them."""

from __future__ import annotations

from quillon.plans import queries_io, queries_joins, queries_metrics, queries_relational, queries_scalar, queries_stages  # noqa: F401
from quillon.plans.registry import oracle_sql, queries  # noqa: F401
