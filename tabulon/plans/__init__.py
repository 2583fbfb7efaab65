"""Registered queries."""

from __future__ import annotations

import importlib

#: The modules that register queries.
MODULES = ["aggregates", "relations", "scalars", "finance", "statistics", "models", "closed", "options"]


def load():
    """The registry, with all queries in it."""
    for name in MODULES:
        importlib.import_module(f"tabulon.plans.{name}")
    return importlib.import_module("tabulon.plans.registry")
