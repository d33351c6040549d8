"""Registry of the engine's own queries over the driver tables."""

from __future__ import annotations

from quarry.plans import assembly_queries, codec_queries, relational_queries, scalar_queries, search_queries
from quarry.plans.tables import Query

FLAGSHIP = "manifest_diff"
_PARTS = (scalar_queries.R, relational_queries.R, search_queries.R, codec_queries.R, assembly_queries.R)
QUERIES: dict[str, Query] = {name: q for r in _PARTS for name, q in r.queries.items()}
ORACLES: dict[str, str] = {name: sql for r in _PARTS for name, sql in r.oracles.items()}
