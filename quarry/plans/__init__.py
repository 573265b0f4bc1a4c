"""Named queries over the driver tables: a Spark plan plus, where SQL can say
the same thing, an equivalent DuckDB SQL oracle.

Each plan module registers its queries with :func:`register`. Every query reads
whole tables (or frames Spark derives from them) and returns a DataFrame whose
column names match its oracle SQL.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

_REGISTRY: dict[str, tuple[Callable, str | None]] = {}

PLAN_MODULES = (
    "lexical", "textual", "vectors", "lsh", "suggest", "related", "corpus", "sources_q", "streams",
    "expansion",
)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load():
    for m in PLAN_MODULES:
        try:
            importlib.import_module(f"quarry.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"quarry.plans.{m}":
                raise


def queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1]}
