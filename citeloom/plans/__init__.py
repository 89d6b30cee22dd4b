"""Query plans, one per operator of the blueprint, and their SQL."""

from __future__ import annotations

from citeloom import catalog


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"citeloom.plans.{name}")


MODULES: tuple[str, ...] = ("texts", "laws", "links", "relations", "tables", "reviews", "streams", "annotations", "reports", "cleaning", "sources")


def queries() -> dict:
    _load()
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(catalog.ORACLES)
