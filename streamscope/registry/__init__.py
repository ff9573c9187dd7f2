"""Every operator as a named query over the driver's tables, with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from .base import QUERIES, SQL

for _area in (
    "predicates", "delivery", "health", "trend", "coverage", "swarm", "access", "media", "live",
):
    import_module(f"{__name__}.{_area}")

__all__ = ["QUERIES", "SQL"]
