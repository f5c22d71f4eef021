"""Collects the queries of the training-data operators."""

from __future__ import annotations

from siftlake.llm import codequeries, docqueries, rowqueries, scorequeries

_MODULES = [rowqueries, scorequeries, codequeries, docqueries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
