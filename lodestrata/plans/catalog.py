"""All core queries by name, with their SQL oracles."""

from __future__ import annotations

from lodestrata.plans import graph_queries, read_queries, snapshots, text_queries

QUERIES = {**snapshots.QUERIES, **text_queries.QUERIES, **graph_queries.QUERIES, **read_queries.QUERIES}
ORACLES = {**snapshots.ORACLES, **text_queries.ORACLES, **graph_queries.ORACLES, **read_queries.ORACLES}
