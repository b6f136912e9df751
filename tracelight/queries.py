"""The engine's registered queries and the SQL they are checked against."""

from __future__ import annotations

from tracelight.plans import command_queries, dump_queries, line_queries, link_queries, network_queries, path_queries

_MODULES = (link_queries, line_queries, command_queries, path_queries, network_queries, dump_queries)

QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}

ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
