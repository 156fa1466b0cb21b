"""Rows dealt by key to so many tasks that the share of a task does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task takes, more or less.
SHARE = 1 << 18


def dealt(rows: DataFrame, keys: list[str], share: int = SHARE) -> tuple[int, DataFrame | None]:
    """The number of tasks that rows need, and the keys with more rows than one share, None without any.

    There are fewer such keys than tasks, so they can be broadcast.
    """
    sizes = rows.groupBy(*keys).count()
    total, longest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).head()
    return total // share + 1, sizes.where(F.col("count") > share).select(*keys) if longest > share else None
