"""All queries of the engine and the SQL that each must equal, gathered from the modules of this package."""

from __future__ import annotations

MODULES = ["relations", "routes", "samples", "texts", "joins", "scoring", "agreement", "publishing", "records", "screening", "learning", "storage", "reports", "roundtrips"]


def _each(name: str) -> dict:
    from importlib import import_module

    out: dict = {}
    for m in MODULES:
        found = getattr(import_module(f"framelens.plans.{m}"), name)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict:
    return _each("QUERIES")


def oracle_sql() -> dict:
    return _each("ORACLE")
