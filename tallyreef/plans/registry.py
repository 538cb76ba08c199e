"""Names of the queries, the functions that build them and their DuckDB equivalents."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name, build, oracle=None):
    """Add a query; oracle is DuckDB SQL over the same tables, or None where SQL cannot express it."""
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = build
    if oracle is not None:
        _ORACLES[name] = oracle


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f".{name}", __package__)


#: Modules of this package that register queries.
MODULES = ["recommender", "texts", "items", "serving"]
