"""Registered queries and their SQL, by theme."""

from . import corpus_queries, graph_queries, kernel_queries, linking_queries, market_queries, panel_queries, relational_queries

QUERIES, SQL = {}, {}
for _module in (graph_queries, relational_queries, corpus_queries, market_queries, kernel_queries, linking_queries, panel_queries):
    QUERIES |= _module.catalog.queries
    SQL |= _module.catalog.sql
