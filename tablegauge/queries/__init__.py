"""Queries over the test tables, one module per operator family."""

from __future__ import annotations

from importlib import import_module

MODULES = ["profiles", "statistics", "cleaning", "charts", "features", "neighbours", "models", "prediction", "versions", "edges"]


def load_all():
    """Import every query module once and return the registry."""
    for name in MODULES:
        import_module(f"tablegauge.queries.{name}")
    return import_module("tablegauge.queries.registry")
