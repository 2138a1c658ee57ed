"""All core queries and their SQL oracles."""

from __future__ import annotations

from quillstate.plans import feature_queries, general_queries, service_queries, state_queries

_MODULES = [state_queries, feature_queries, general_queries, service_queries]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.ORACLE
    return out
