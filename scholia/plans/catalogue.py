"""Queries and oracles of the engine's own operators."""

from __future__ import annotations

from scholia.plans import graph_queries, metric_queries, people_queries, record_queries, shape_queries

_PARTS = (record_queries.REGISTRY, metric_queries.REGISTRY, graph_queries.REGISTRY, people_queries.REGISTRY, shape_queries.REGISTRY)
QUERIES = {name: q for part in _PARTS for name, q in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.oracles.items()}
