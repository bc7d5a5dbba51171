"""Named queries over the stand-in tables, each with an independent SQL statement where SQL can say it."""

from __future__ import annotations

from tidemark.registry import aggregations, columns, comparisons, estimates, experiments, market, modelling, quality, sources, timelines, users
from tidemark.registry.base import REGISTRY, oracle_sql, queries

__all__ = [
    "REGISTRY",
    "aggregations",
    "columns",
    "comparisons",
    "estimates",
    "experiments",
    "market",
    "modelling",
    "oracle_sql",
    "quality",
    "queries",
    "sources",
    "timelines",
    "users",
]
