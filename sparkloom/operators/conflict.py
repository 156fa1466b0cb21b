"""Two sources for one series: precedence, audit and escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.strings import relative_difference_percent


def resolve(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """Full outer join where the preferred source wins; tells which source each value is from."""
    keys = ["series_id", "as_of"]
    joined = preferred.select(*keys, F.col("value").alias("a")).join(other.select(*keys, F.col("value").alias("b")), keys, "full_outer")
    return joined.select(*keys, F.coalesce("a", "b").alias("value"), F.when(F.col("a").isNotNull(), "preferred").otherwise("other").alias("source"))


def audit(preferred: DataFrame, other: DataFrame, least: float = 1e-12) -> DataFrame:
    """The periods that both have, with absolute and relative difference."""
    keys = ["series_id", "as_of"]
    joined = preferred.select(*keys, F.col("value").alias("a")).join(other.select(*keys, F.col("value").alias("b")), keys)
    gap = F.abs(F.col("a") - F.col("b"))
    return joined.select(*keys, "a", "b", gap.alias("abs_diff"), relative_difference_percent(F.col("a"), F.col("b")).alias("pct_diff"), (gap > least).alias("is_conflict"))


def conflict_stats(preferred: DataFrame, other: DataFrame, most_percent: float = 5.0) -> DataFrame:
    """Overlap, conflicts and their share by series; escalates above the limit, not at it."""
    counts = audit(preferred, other).groupBy("series_id").agg(F.count("*").alias("overlap"), F.count_if("is_conflict").alias("conflicts"))
    share = F.coalesce(F.try_divide(F.col("conflicts") * 100.0, F.col("overlap")), F.lit(0.0))
    return counts.withColumn("conflict_percent", share).withColumn("escalate", F.col("conflict_percent") > most_percent)
