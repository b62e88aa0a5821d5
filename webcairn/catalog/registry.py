"""All registered queries and their oracle statements."""

from __future__ import annotations

from webcairn.catalog import q_discovery, q_documents, q_monitor, q_pages, q_plans, q_reports, q_streams

_MODULES = (q_pages, q_documents, q_discovery, q_monitor, q_reports, q_streams, q_plans)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
