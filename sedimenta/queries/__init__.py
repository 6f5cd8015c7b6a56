"""The registered queries of the core and their SQL; each module has QUERIES and SQL."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    from sedimenta.queries import corpus, fixtures, graphs, pipeline, retrieval

    found, sql = {}, {}
    for module in (pipeline, corpus, fixtures, graphs, retrieval):
        found |= module.QUERIES
        sql |= module.SQL
    return found, sql
