"""The hook for a user-supplied model: rows in, rows out, one load per worker task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Model = Callable[[pd.DataFrame], pd.DataFrame]


def score_batches(df: DataFrame, load: Callable[[], Model], out_schema: str, batch: int = 64) -> DataFrame:
    """Append the columns of ``out_schema`` computed by ``load()(rows)`` on batches of at most ``batch`` rows.

    A failing batch is halved until the bad rows stand alone. Such a row is kept: its text columns say
    ``ERROR: <reason>`` and its other columns are null.
    """
    out = T.StructType.fromDDL(out_schema)
    names = [f.name for f in out]
    texts = {f.name for f in out if isinstance(f.dataType, T.StringType)}

    def failed(index: pd.Index, reason: Exception) -> pd.DataFrame:
        row = {n: f"ERROR: {reason}" if n in texts else None for n in names}
        return pd.DataFrame([row] * len(index), index=index, columns=names)

    def attempt(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
        result = model(rows)
        if len(result) != len(rows):
            raise ValueError(f"model returned {len(result)} rows for {len(rows)}")
        return result[names].set_axis(rows.index, axis=0)

    def settle(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
        """Halve a failing batch until the rows that cannot be scored stand alone."""
        try:
            return attempt(model, rows)
        except Exception as reason:  # noqa: BLE001 - one bad row must not lose its batch
            if len(rows) == 1:
                return failed(rows.index, reason)
            half = len(rows) // 2
            return pd.concat([settle(model, rows.iloc[:half]), settle(model, rows.iloc[half:])])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for rows in batches:
            for at in range(0, len(rows), batch):
                model = model or load()
                part = rows.iloc[at:at + batch]
                yield pd.concat([part, settle(model, part)], axis=1)

    return df.mapInPandas(score, T.StructType([*df.schema.fields, *out.fields]))
