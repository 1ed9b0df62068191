"""Order-insensitive comparison of a Spark result with a DuckDB result, columns sorted by name."""

from __future__ import annotations

import math


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(columns_a, rows_a, columns_b, rows_b, limit: int = 5) -> list[str]:
    if sorted(columns_a) != sorted(columns_b):
        return [f"columns {sorted(columns_a)} vs {sorted(columns_b)}"]
    a, b = canonical(columns_a, rows_a), canonical(columns_b, rows_b)
    out = [] if len(a) == len(b) else [f"rows {len(a)} vs {len(b)}"]
    out += [f"{x} vs {y}" for x, y in zip(a, b) if x != y][:limit]
    return out
