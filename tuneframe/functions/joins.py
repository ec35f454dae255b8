"""Size-checked broadcast joins.

A side is broadcast only when the optimizer's own size estimate for it is
under a bound; otherwise the join is left to the planner (sort-merge, with
AQE free to switch at run time). Reading plan statistics runs no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (None when unavailable)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - e.g. Spark Connect sessions
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    size = estimated_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``left.join(right)`` broadcasting ``right`` only behind the size check."""
    return left.join(broadcast_if_small(right, max_bytes), on=on, how=how)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame (a global aggregate) to every row.

    ``one_row`` comes from an ungrouped ``agg`` and has exactly one row, so
    the broadcast is a single row and no pairs are formed.
    """
    return df.crossJoin(F.broadcast(one_row))
