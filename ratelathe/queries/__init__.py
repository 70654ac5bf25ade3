"""Registered queries with their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("problems", "reference", "roundtrips")


def _merged(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
