"""Every operator and job over the driver's tables, each with its SQL twin.

:mod:`standin` maps the tables to the record, visit, taxon and place frames the jobs read; the other
modules register queries. ``all_queries()`` and ``all_sql()`` feed ``__spark_entry__``.
"""

from __future__ import annotations

from .registry import REGISTRY


def _load():
    from . import building_blocks, jobs, listings, maps, streams  # noqa: F401  (registration)

    return REGISTRY


def all_queries() -> dict:
    return {q.name: q.run for q in _load().values()}


def all_sql() -> dict:
    return {q.name: q.sql for q in _load().values() if q.sql}


def coverage() -> dict[str, list[str]]:
    """Inventory id -> queries that show it."""
    out: dict[str, list[str]] = {}
    for q in _load().values():
        for item in q.covers:
            out.setdefault(item, []).append(q.name)
    return out
