"""Every registered query of the document and table operators, with its DuckDB counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("text_queries", "table_queries", "plan_queries", "diff_queries", "more_queries", "sheet_queries", "page_queries", "document_queries", "package_queries", "file_queries", "carry_queries", "media_queries", "revision_queries", "merging_queries")
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"docloom.operators.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
