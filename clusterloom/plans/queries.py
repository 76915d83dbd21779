"""Registered queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from . import atlas_queries, comparison_queries, learning_queries, point_queries, run_queries, surface_queries, trial_queries

_MODULES = (run_queries, trial_queries, atlas_queries, point_queries, comparison_queries, surface_queries, learning_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
