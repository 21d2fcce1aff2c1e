"""Registered queries: each reads the given tables through ``views``."""

from importlib import import_module

MODULES = ("scans", "columns", "joins", "aggs", "windows", "scalars", "graphs", "geometry", "reviews", "registry", "streams")


def load():
    from tractum.catalog import base

    for name in MODULES:
        import_module(f"tractum.catalog.{name}")
    return base.QUERIES, base.ORACLES
