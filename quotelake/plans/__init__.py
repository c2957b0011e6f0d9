"""Whole queries, put together from operators, with their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

from quotelake.plans.registry import QUERIES, Query

MODULES = ("relational", "scalars", "pages", "events", "domain", "texts", "tariffs", "surveys", "findings", "records", "labels")


def load() -> dict[str, Query]:
    """All registered queries."""
    for name in MODULES:
        import_module(f"quotelake.plans.{name}")
    return QUERIES
