"""All registered queries and their check SQL."""

from __future__ import annotations

from importlib import import_module

from millrace.queries.registry import ORACLES, QUERIES, Query

_GROUPS = ["profiling", "cleaning", "splitting", "catalogue", "texts", "monitoring", "storage"]


def _load() -> None:
    for group in _GROUPS:
        import_module(f"millrace.queries.{group}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
