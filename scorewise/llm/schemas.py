"""Columns that pass through an operator. An input column named like an output (in any case) is replaced by it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def passing(columns: Sequence[str], outputs: Sequence[str]) -> list[str]:
    taken = {name.lower() for name in outputs}
    return [c for c in columns if c.lower() not in taken]


def extended(df: DataFrame, columns: Sequence[str], added: str) -> tuple[list[str], T.StructType]:
    """For a task function that adds the columns of a DDL string: which of ``columns`` pass, and the whole schema."""
    fields = T.StructType.fromDDL(added).fields
    passed = passing(columns, [f.name for f in fields])
    return passed, T.StructType([*(df.schema[c] for c in passed), *fields])


def whole_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All columns as one, ``row``, so that none can clash with the names an operator uses inside."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]).alias("row")


def unpacked(columns: Sequence[str]) -> list[Column]:
    return [F.col("row")[c].alias(c) for c in columns]
