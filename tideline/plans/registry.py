"""All registered queries of the engine itself, and their SQL for the independent check."""

from __future__ import annotations

from tideline.plans import corpus_queries, intelligence_queries, relational, service_queries

_MODULES = (relational, corpus_queries, intelligence_queries, service_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
