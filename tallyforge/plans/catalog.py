"""Every query of the reference's operators by name, with the SQL that checks it."""

from __future__ import annotations

from . import document_queries, fact_queries, record_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (fact_queries, record_queries, document_queries):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
