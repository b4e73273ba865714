"""Every operator bound to the driver's tables, with equivalent SQL where SQL can express it.

A module of this package registers its queries with :func:`learnloom.queries.registry.query`.
"""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("corpus", "relations", "graph", "recommend", "emotions", "messages", "streams", "plans", "files")
for _name in MODULES:
    import_module(f"{__name__}.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
