"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from terravane.plans import catalog, geodesy, georeference, logs, preparation, products, rasters, sources, structures, surveys, telemetry, terrain

MODULES = [preparation, telemetry, terrain, rasters, geodesy, georeference, sources, logs, surveys, structures, products, catalog]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out |= module.ORACLE
    return out
