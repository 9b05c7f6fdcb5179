"""All registered queries of the event engine with their SQL twins."""

from __future__ import annotations

from pulselake.plans import feature_queries, model_queries, record_queries, trace_queries

QUERIES: dict = trace_queries.QUERIES | record_queries.QUERIES | model_queries.QUERIES | feature_queries.QUERIES
ORACLES: dict = trace_queries.ORACLES | record_queries.ORACLES | model_queries.ORACLES | feature_queries.ORACLES
