"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from .plans import library, search, storage

_FAMILIES = (library, search, storage)


def queries() -> dict:
    return {k: q for f in _FAMILIES for k, q in f.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for f in _FAMILIES for k, q in f.ORACLE.items()}
