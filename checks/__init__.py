"""Registered queries and, next to each, the independent SQL that must give the same rows."""

from importlib import import_module

GROUPS = ["ehr", "text", "labels", "correct", "corpus", "qc", "evaluate", "sources"]


def load_all() -> None:
    for group in GROUPS:
        import_module(f"checks.{group}")
