"""Registered queries by theme, each beside its DuckDB SQL."""

from __future__ import annotations

from cairn.registered import columns, flowing, focusing, graphing, packing, sources, varied, writing

MODULES = [columns, sources, varied, focusing, graphing, flowing, packing, writing]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
