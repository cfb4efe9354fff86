"""The queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

from .queries import corpus, pairs, records, texts

_MODULES = (texts, pairs, records, corpus)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
