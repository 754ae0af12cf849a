"""The registered queries of the engine and the SQL that each one equals."""

from __future__ import annotations

from siltstone.plans import curation_queries, retrieval_queries, service_queries, text_queries

MODULES = (text_queries, curation_queries, retrieval_queries, service_queries)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
