"""Registry of named queries: Spark builder + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    survey_ids: tuple[str, ...]
    doc: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | Callable[[], str] | None = None, ids: tuple[str, ...] = ()):
    """Decorator: ``@register("r10_rank_distribution", sql=..., ids=("R10",))``."""
    def deco(fn):
        text = sql() if callable(sql) else sql
        _REGISTRY[name] = Query(name, fn, text, tuple(ids), (fn.__doc__ or "").strip())
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # importing the catalogue modules fills the registry
    from . import (catalog_clean, catalog_eval, catalog_features, catalog_ml, catalog_relational,  # noqa: F401
                   catalog_streaming, catalog_io, catalog_explore, catalog_sheets, catalog_reduce, catalog_store, catalog_profile)
    return dict(_REGISTRY)
