"""The registry of core queries and of the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, times: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Add a query, and its SQL where SQL can express it. ``times`` are timestamps in its
    result; they are shown as microseconds, which both engines write alike."""

    def add(query: Query) -> Query:
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(spark, sf_dir).withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in times})

        _QUERIES[name] = shown if times else query
        if sql is not None:
            micros = ", ".join(f"epoch_us({c}) AS {c}" for c in times)
            _ORACLES[name] = f"SELECT * REPLACE ({micros}) FROM ({sql})" if times else sql
        return query

    return add


def queries() -> dict[str, Query]:
    from loam.plans import core_queries  # noqa: F401  (registers itself)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from loam.plans import core_queries  # noqa: F401  (registers itself)

    return dict(_ORACLES)
