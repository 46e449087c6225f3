"""All registered queries."""

from __future__ import annotations

import importlib

from tidewatch.plans.registry import ORACLE, QUERIES

FAMILIES = ["io", "project", "joins", "intervals", "aggregate", "select", "timing", "evaluate", "models", "streams"]
for _family in FAMILIES:
    importlib.import_module(f"tidewatch.plans.{_family}")


def flagship(spark, sf):
    return QUERIES["e8_interval_summary"](spark, sf)


__all__ = ["ORACLE", "QUERIES", "flagship"]
