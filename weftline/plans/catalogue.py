"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from weftline.plans import drift, evaluation, extra, instants, ledger, more, sessions, streams, views, work

MODULES = (instants, drift, sessions, work, evaluation, extra, views, ledger, more, streams)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
