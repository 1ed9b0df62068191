"""Stand-in tables over the driver data, and the registered queries with their SQL twins."""

from __future__ import annotations

import importlib

_MODULES = (
    "series_queries", "sampling_queries", "metrics_queries", "judged_queries", "vector_queries", "chat_queries",
)


def load():
    """All registered queries and their SQL twins, by name."""
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
