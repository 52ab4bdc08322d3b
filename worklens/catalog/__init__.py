"""The named queries, grouped by family."""

from __future__ import annotations

import importlib

FAMILIES = ["normalizing", "filtering", "ranking", "tracking", "extracting", "deduplication", "sourcing", "matching", "streams"]


def load():
    """Import every family, which registers its queries, and return the registry."""
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return importlib.import_module(f"{__name__}.registry")
