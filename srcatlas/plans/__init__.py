"""Registered queries: each module has QUERIES (name -> callable) and SQL (name -> text for DuckDB)."""

from __future__ import annotations

from importlib import import_module

CORE = ("reference_queries", "index_queries", "graph_queries")


def core_modules() -> list:
    return [import_module(f"srcatlas.plans.{name}") for name in CORE]
