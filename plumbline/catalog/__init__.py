"""All named queries."""

from __future__ import annotations

from importlib import import_module

from plumbline.catalog.registry import ORACLE, QUERIES, Query

MODULES = ("tables", "features", "house", "scores", "models", "ensembles")


def _load() -> None:
    for m in MODULES:
        import_module(f"plumbline.catalog.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
