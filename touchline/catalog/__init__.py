"""Registered queries, one module per operator family."""

from importlib import import_module

MODULES = ["event_queries", "score_queries", "cluster_queries", "market_queries", "profile_queries"]


def load() -> None:
    for name in MODULES:
        import_module(f"touchline.catalog.{name}")
