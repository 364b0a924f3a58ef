"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows; else as it is, for a shuffled join.

    The count stops at the limit. Callers pass tables of narrow rows (keys and numbers, under 100 bytes).
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
