"""All queries of the core engine."""

from __future__ import annotations

from kinvote.plans import artifacts, hierarchy, skew, transfer

_PARTS = (transfer, artifacts, skew, hierarchy)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
