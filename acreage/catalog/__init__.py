"""Every registered query: how Spark builds it, and the same question in SQL where there is one."""

from __future__ import annotations

from importlib import import_module

MODULES = ("market", "cleaning", "profiling", "features", "accounts", "location", "texts", "modelling", "streams", "files")


def all_entries() -> dict:
    """Name → (build(spark, sf_dir), SQL or None)."""
    found: dict = {}
    for name in MODULES:
        entries = import_module(f"acreage.catalog.{name}").ENTRIES
        clash = found.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= entries
    return found
