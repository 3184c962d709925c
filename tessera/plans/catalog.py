"""All registered queries of the matching and novelty engine, with their SQL."""

from __future__ import annotations

from tessera.plans import discovery_queries, matching_queries, more_queries, novelty_queries, streaming_queries  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
