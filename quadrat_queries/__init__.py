"""Named queries, grouped by subject."""

from importlib import import_module

MODULES = ("scalars", "records", "space", "mapped", "sensitive", "resolve", "sources", "headers")


def load_all() -> None:
    for name in MODULES:
        import_module(f"quadrat_queries.{name}")
