"""The registered llm queries and their SQL."""

from __future__ import annotations

from sedimenta.llm import queries_documents, queries_near, queries_source

QUERIES: dict = {}
SQL: dict = {}
for _module in (queries_near, queries_source, queries_documents):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
