"""Registered queries: each applies library operators to the given tables; most have DuckDB SQL for the same rows."""

from __future__ import annotations

import importlib

MODULES = ("scan", "derive", "joins", "profile", "panels", "scores", "models", "streams")


def load() -> tuple[dict, dict]:
    """(queries, SQL) of all modules."""
    from .registry import QUERIES, SQL

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(QUERIES), dict(SQL)
