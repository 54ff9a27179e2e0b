"""Queries by name over the given tables, with SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from opsreliability.catalog.base import ORACLE, QUERIES, with_views

AREAS = ("sources", "scalars", "relational", "ordering", "builders", "marts", "gate", "features",
         "series", "evaluation", "learning", "scoring", "measures", "reports")


def load() -> tuple[dict, dict]:
    for area in AREAS:
        import_module(f"opsreliability.catalog.{area}")
    return QUERIES, {name: with_views(sql) for name, sql in ORACLE.items()}
