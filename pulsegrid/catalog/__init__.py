"""Runnable queries, one module per part of the library."""

from importlib import import_module

MODULES = ("q_sources", "q_joins", "q_stats", "q_features", "q_metrics", "q_models", "q_checks")


def load_all() -> None:
    for name in MODULES:
        import_module(f"pulsegrid.catalog.{name}")
