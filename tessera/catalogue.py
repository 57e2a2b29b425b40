"""Registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from tessera.plans import candidates, decisions, learning, texts
from tessera.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = candidates.benchmark_passage_linkage

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "candidates", "decisions", "learning", "texts"]
