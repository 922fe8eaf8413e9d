"""Every query of the library with the SQL that gives the same rows."""
from __future__ import annotations

from . import evaluation_queries, evidence_queries, layout_queries, reader_queries, review_queries, source_queries, state_queries, text_queries, token_queries

PARTS = (text_queries, token_queries, state_queries, source_queries, layout_queries, evidence_queries, reader_queries, review_queries, evaluation_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
