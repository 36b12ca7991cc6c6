"""Collects the query modules."""

from importlib import import_module

from queries.base import ORACLES, QUERIES

MODULES = ("recipe_queries", "profile_queries", "table_queries", "answer_queries", "text_queries", "source_queries", "lifecycle_queries")


def load():
    for name in MODULES:
        import_module(f"queries.{name}")
    return QUERIES, ORACLES
