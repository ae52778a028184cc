"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from docslice.plans import chunks, documents, expected, extra, formats, insight, more, splits

MODULES = (splits, chunks, documents, extra, more, insight, formats)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()} | expected.ORACLE_SQL
