"""Equi-join for a big side whose key may be concentrated in few values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def join_per_key(
    rows: DataFrame, per_key: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which holds one line per key and its row count.

    Keys with more than ``hot_rows`` rows are at most ``rows / hot_rows`` many, so that part of
    ``per_key`` has a proven bound and is broadcast: hot rows stay where they are. All other keys
    shuffle, and none of them is big.
    """
    hot = F.broadcast(per_key.filter(F.col(size) > hot_rows))
    cold = per_key.filter(F.col(size) <= hot_rows)
    calm = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(calm.join(cold, key))
