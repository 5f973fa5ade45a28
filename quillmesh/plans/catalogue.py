"""All queries of the core by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from quillmesh.plans import graphs, nested, reports, retrieval, scalars, search

FLAGSHIP = "hybrid_retrieve"
PLANS = (scalars, retrieval, graphs, search, reports, nested)
QUERIES = {k: v for plan in PLANS for k, v in plan.QUERIES.items()}
SQL: dict[str, str] = {k: v for plan in PLANS for k, v in plan.SQL.items()}
