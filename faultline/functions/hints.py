"""Join hints with a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast bound for dimension tables (releases, per-release counts).
DIM_MAX_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (file sizes for stored tables,
    an upper bound after filters and projections; no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = DIM_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` when its estimated size is at most ``max_bytes``;
    otherwise return it unchanged and let the planner and AQE pick the join
    from measured sizes.  Meant for dimension tables (one row per release,
    per project, ...) that are stored, so the estimate is the file size."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df
