"""All registered queries of the library, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "agg2_layer_share"
_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); `sql` is the same in DuckDB's SQL."""

    def add(f):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    from glimmer import plans  # noqa: F401  registers on import


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
