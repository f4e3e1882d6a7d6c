"""Queries over the given tables: derived inputs, the query catalog and its reference SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) query, with the SQL that states its result on the same tables."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def load_all() -> None:
    from docfields.plans import (  # noqa: F401
        corrections,
        extraction,
        functions,
        layouts,
        log,
        pages,
        records,
        texts,
    )
