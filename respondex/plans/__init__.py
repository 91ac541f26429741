"""Named queries over the tables."""

from __future__ import annotations

import importlib

_AREAS = ("sources", "profiling", "text", "timing", "matrix", "duplicates", "similarity", "lift", "scoring", "evaluation", "integrity", "models", "streaming")


def load_catalog():
    """Import every area once and return name -> query."""
    from respondex.plans.catalog import CATALOG

    for area in _AREAS:
        importlib.import_module(f"respondex.plans.{area}_queries")
    return CATALOG
