"""Every runnable query by name, with its DuckDB check where plain SQL can state it."""

from __future__ import annotations

import importlib

from kinforge.catalog import base

MODULES = ("scalars", "tree", "scoring", "civil", "sources", "review", "linking", "evidence_chain", "intake")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"kinforge.catalog.{m}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql():
    _load()
    return dict(base.ORACLE)
