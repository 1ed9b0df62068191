"""Registered queries: a Spark callable, its output columns, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.session import configure

from .fixtures import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPARK = {
    "i": lambda c: F.col(c).cast("long").alias(c),
    "d": lambda c: F.round(F.col(c).cast("double"), 6).alias(c),
    "s": lambda c: F.col(c).cast("string").alias(c),
    "b": lambda c: F.col(c).cast("boolean").alias(c),
}
_SQL = {
    "i": "cast({0} as bigint) as {0}",
    "d": "round(cast({0} as double), 6) as {0}",
    "s": "cast({0} as varchar) as {0}",
    "b": "cast({0} as boolean) as {0}",
}


def query(name: str, cols: str, oracle: str | None = None, **steps: str) -> Callable[[Query], Query]:
    """Register a query. ``cols`` lists ``name:type`` with type i(nteger), d(ouble), s(tring) or b(oolean)."""
    spec = [c.split(":") for c in cols.split()]

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir).select(*[_SPARK[t](c) for c, t in spec])

        QUERIES[name] = run
        if oracle is not None:
            picked = ", ".join(_SQL[t].format(c) for c, t in spec)
            ORACLES[name] = sql(f"select {picked} from answer", **steps, answer=oracle)
        return fn

    return register
