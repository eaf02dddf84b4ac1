"""All queries of the engine, by name, and their oracles."""

from __future__ import annotations

from quayside.plans import queries_catalog, queries_objects, queries_ordered, queries_scalars, queries_sources, queries_streaming, queries_telemetry

_MODULES = (queries_scalars, queries_catalog, queries_ordered, queries_telemetry, queries_objects, queries_sources, queries_streaming)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
