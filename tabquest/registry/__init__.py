"""Registered queries over the given tables and the SQL they are compared with."""

from __future__ import annotations

from tabquest.registry import audit, metrics, plans, retrieval, search, tables, text

_GROUPS = (tables, text, retrieval, audit, metrics, plans, search)


def all_queries() -> dict:
    found = {}
    for group in _GROUPS:
        found.update(group.QUERIES)
    return found


def all_oracles() -> dict:
    found = {}
    for group in _GROUPS:
        found.update(group.ORACLES)
    return found
