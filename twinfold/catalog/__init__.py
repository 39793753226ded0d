"""Every registered query with its SQL twin."""

from __future__ import annotations

from importlib import import_module

MODULES = ("matching", "gating", "audits", "quality", "scalars", "reviewing")


def _modules():
    return [import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
