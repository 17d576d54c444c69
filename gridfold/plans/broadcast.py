"""Size-checked broadcast.

A side is broadcast only after its row count has been measured against a
bound; otherwise the join is left to the planner (sort-merge / shuffled hash,
with AQE free to convert it at runtime once real sizes are known).  The count
is bounded too (``limit(max_rows + 1)``), so checking a big table stops early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a small dimension (points, windows of points, class tables) that we
# accept to ship to every executor.  At ~100 bytes a row this is ~50 MB.
DEFAULT_MAX_BROADCAST_ROWS = 500_000


def row_count_at_most(df: DataFrame, max_rows: int) -> int | None:
    """Exact row count if it is <= max_rows, else None."""
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else df."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) is not None else df
