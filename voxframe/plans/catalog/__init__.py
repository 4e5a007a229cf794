"""The query catalog: one entry per operator, each over whole tables."""

from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY, Query

for _part in ("geometry_queries", "statistics_queries", "patch_queries", "resample_queries", "morphology_queries", "run_queries"):
    import_module(f"{__name__}.{_part}")

__all__ = ["REGISTRY", "Query"]
