"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from reprolens.plans import graph_queries, mapping_queries, record_queries, stream_queries, study_queries

_PARTS = (graph_queries, mapping_queries, study_queries, stream_queries, record_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
