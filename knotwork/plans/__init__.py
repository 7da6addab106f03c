"""Registered queries with their oracle SQL, by subject."""

from importlib import import_module

NAMES = ("records", "structure", "code", "text", "files")


def modules() -> list:
    return [import_module(f"{__name__}.{name}") for name in NAMES]
