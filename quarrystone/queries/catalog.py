"""All queries outside the training-data subpackage, by name, with their SQL."""

from __future__ import annotations

from quarrystone.queries import aggregates, dialect, filters_joins, graphs, measures, procedures, ranking, retrieval, streams, texts, windows

_SHARED = {**filters_joins.QUERIES, **aggregates.QUERIES, **windows.QUERIES, **ranking.QUERIES, **texts.QUERIES, **graphs.QUERIES}

QUERIES = {**{name: dialect.query(text) for name, text in _SHARED.items()}, **procedures.QUERIES, **retrieval.QUERIES, **streams.QUERIES, **measures.QUERIES}
SQL = {**{name: dialect.duckdb_sql(text) for name, text in _SHARED.items()}, **procedures.SQL, **retrieval.SQL, **streams.SQL, **measures.SQL}
