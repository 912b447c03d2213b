"""All queries over the given tables and their DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from palmleaf.plans import essays, extraction, graph, history, resolution, streams

QUERIES: dict = {**essays.QUERIES, **graph.QUERIES, **history.QUERIES, **resolution.QUERIES, **extraction.QUERIES, **streams.QUERIES}
ORACLE: dict[str, str] = {**essays.ORACLE, **graph.ORACLE, **history.ORACLE, **resolution.ORACLE, **extraction.ORACLE, **streams.ORACLE}
