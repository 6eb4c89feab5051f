"""Queries over the test tables."""

MODULES = ("evaluation", "boxes", "phenotype", "detection", "raster", "datasets")


def load():
    """All registered queries and their DuckDB counterparts."""
    from importlib import import_module

    for module in MODULES:
        import_module(f".{module}", __name__)
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
