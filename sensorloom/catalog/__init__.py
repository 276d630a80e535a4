"""Queries that bind the operators to the benchmark tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from sensorloom.catalog.base import Catalog

AREAS = ["sources", "cleaning", "joins", "gridding", "windowing", "eventing", "projections", "statistics", "modeling", "exploring"]


def load() -> Catalog:
    whole = Catalog()
    for area in AREAS:
        whole.extend(import_module(f"sensorloom.catalog.{area}").CATALOG)
    return whole
