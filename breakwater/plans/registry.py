"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .views import ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(
    name: str,
    *,
    over: Sequence[str] = (),
    steps: Sequence[tuple[str, str]] = (),
    sql: str | None = None,
) -> Callable[[Query], Query]:
    """Register a query.  Its oracle is ``sql`` over the views named in ``over`` and the
    CTEs in ``steps``; without ``sql`` only its rows are checked."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            defined = [d for d in [ctes(*over) if over else "", *[f"{n} AS ({q})" for n, q in steps]] if d]
            ORACLES[name] = ("WITH " + ",\n".join(defined) + "\n" if defined else "") + sql.strip()
        return fn

    return keep
