"""All registered queries with their DuckDB texts (None = rows-only check)."""

from __future__ import annotations

import importlib

MODULES = ["catalog_queries", "planning_queries", "pixel_queries", "region_queries", "ocr_queries", "job_queries"]


def all_queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(importlib.import_module(f"rasterloom.plans.{module}").QUERIES)
    return found
