"""Registered queries by area; importing an area registers its queries."""

from __future__ import annotations

import importlib

AREAS = ("extraction", "messages", "records", "credits", "streams", "scalars")


def load():
    """(queries, SQL checks) by name."""
    from webloom.plans import registry

    for area in AREAS:
        importlib.import_module(f"webloom.plans.{area}")
    return dict(registry.QUERIES), dict(registry.ORACLE)
