"""Every query of the reference's own operators, and its DuckDB SQL."""

from __future__ import annotations

from . import claim_queries, document_queries, extraction_queries, price_queries, report_queries, review_queries, text_queries

QUERIES = price_queries.QUERIES | claim_queries.QUERIES | text_queries.QUERIES | document_queries.QUERIES | review_queries.QUERIES | extraction_queries.QUERIES | report_queries.QUERIES
ORACLES = price_queries.ORACLES | claim_queries.ORACLES | text_queries.ORACLES | document_queries.ORACLES | review_queries.ORACLES | extraction_queries.ORACLES | report_queries.ORACLES
