"""All registered queries by name, and the SQL that states the same results."""

from __future__ import annotations

import functools
import importlib

from quillstack.session import ship_package

MODULES = (
    "search_queries", "text_queries", "prep_queries", "source_queries", "model_queries",
    "language_queries", "enrich_queries",
)


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"quillstack.plans.{name}"), attribute)
        overlap = out.keys() & part.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        out.update(part)
    return out


def with_package(query):
    @functools.wraps(query)
    def run(spark, folder):
        ship_package(spark)
        return query(spark, folder)

    return run


def all_queries() -> dict:
    return {name: with_package(query) for name, query in _merged("QUERIES").items()}


def all_sql() -> dict[str, str]:
    return _merged("SQL")
