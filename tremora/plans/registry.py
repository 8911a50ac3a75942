"""Catalogue of named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, needs: list[str] | None = None) -> None:
    _CTES[name] = (body, needs or [])


def sql(body: str, needs: list[str]) -> str:
    """Prefix ``body`` with the named building blocks it needs, in dependency order."""
    order: list[str] = []

    def visit(n):
        for m in _CTES[n][1]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n][0]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{body}"


def query(name: str, oracle: str | None = None, needs: list[str] | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle, needs or [])
        return fn

    return add
