"""The registered queries and their SQL."""

from __future__ import annotations

from graphloom.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "knn_topk"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
