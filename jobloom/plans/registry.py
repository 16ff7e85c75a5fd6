"""All registered queries with their SQL."""

from __future__ import annotations

from jobloom.plans import functions, landing, languages, loading, relational, streams, texts  # noqa: F401
from jobloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
