"""Runnable queries over the driver tables."""

from importlib import import_module

from .catalog import REGISTRY, Query

MODULES = ("market", "cleaning", "joining", "sentiment", "quality", "trading", "modeling", "streams", "tables", "inputs")


def load_queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
