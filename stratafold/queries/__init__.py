"""Registered queries, one module per group of operators."""

from importlib import import_module

from stratafold.registry import ORACLES, QUERIES

MODULES = ("sources", "scalars", "joins", "aggregates", "evaluation", "rays", "profiles", "raster", "regions", "carved", "shapes", "streams")


def load_all():
    for name in MODULES:
        import_module(f"stratafold.queries.{name}")
    return QUERIES, ORACLES
