"""Queries of the engine's own operators, with equivalent DuckDB SQL."""

from brindle.plans import history_queries, mining_queries, parser_queries, rule_queries, search_queries, text_queries, tool_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (history_queries, search_queries, text_queries, mining_queries, parser_queries, rule_queries, tool_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
