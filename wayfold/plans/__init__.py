"""Every operator bound to the test tables, next to the SQL that checks it."""

from importlib import import_module

MODULES = ("rewards", "tokens", "batches", "evaluation", "scoring", "maps", "sampling", "parsing", "graph", "datasets", "files")


def load():
    from wayfold.plans import catalog

    for m in MODULES:
        import_module(f"wayfold.plans.{m}")
    return dict(catalog.QUERIES), dict(catalog.ORACLES)
