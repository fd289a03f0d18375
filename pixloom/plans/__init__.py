"""Registered queries by subject."""

from importlib import import_module

MODULES = ("statistics", "records", "shapes", "sampling", "streams", "files")


def load_all() -> None:
    for name in MODULES:
        import_module(f"pixloom.plans.{name}")
