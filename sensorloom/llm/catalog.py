"""All queries of this subpackage and their SQL twins."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from sensorloom.llm.common import importable

MODULES = ["op01", "op02", "op03", "op04", "op05", "op06", "op07", "op08", "op09", "op10", "op11", "op12", "op13"]


def load() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = import_module(f"sensorloom.llm.{name}")
        queries.update({k: _bound(f) for k, f in module.QUERIES.items()})
        sql.update(module.SQL)
    return queries, sql


def _bound(query):
    @wraps(query)
    def run(spark, folder):
        return query(importable(spark), folder)

    return run
