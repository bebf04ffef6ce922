"""Queries of the library, by subject."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ["tables", "texts", "vectors", "graphs", "chunks", "code", "structures", "mappings"]


def queries() -> dict:
    return {k: f for s in SUBJECTS for k, f in import_module(f"{__name__}.{s}").C.queries.items()}


def oracle_sql() -> dict:
    return {k: f for s in SUBJECTS for k, f in import_module(f"{__name__}.{s}").C.sql.items()}
