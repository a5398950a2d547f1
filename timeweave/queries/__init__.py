"""Named queries over the engine's operators, each with its SQL where SQL can say it."""

import importlib

MODULES = ["tables", "scalars", "filters", "windows", "joins", "retrieval", "housekeeping", "parts"]


def load():
    """The registry with all modules' queries."""
    for name in MODULES:
        importlib.import_module(f"timeweave.queries.{name}")
    return importlib.import_module("timeweave.queries.base")
