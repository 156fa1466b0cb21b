"""Monthly, quarterly and annual return series: alignment, spines, gaps and checks.

Series are long tables (series_id, frequency, as_of, value); every operator works on all series
at once, keyed by series_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.dates import month_ends, period_end


def normalize_series(points: DataFrame) -> DataFrame:
    """as_of moved to the period's end, with flags for duplicates and order breaks after that, in input order (``ord``)."""
    by_series = Window.partitionBy("series_id", "frequency")
    snapped = points.withColumn("period", period_end(F.col("as_of"), F.col("frequency")))
    before = F.lag("period").over(by_series.orderBy("ord"))
    return snapped.withColumns(
        {
            "duplicate": F.count("*").over(Window.partitionBy("series_id", "frequency", "period")) > 1,
            "out_of_order": F.coalesce(F.col("period") < before, F.lit(False)),
        }
    )


def series_issues(points: DataFrame) -> DataFrame:
    """One row for each check that a series fails, with how often: (series_id, issue, n)."""
    checked = normalize_series(points)
    flags = {
        "duplicate_period": F.col("duplicate"),
        "out_of_order": F.col("out_of_order"),
        "not_finite": F.col("value").isNull() | F.isnan("value") | F.col("value").isin(float("inf"), float("-inf")),
        "unknown_frequency": F.col("period").isNull(),
    }
    counts = checked.groupBy("series_id").agg(*[F.count_if(c).alias(k) for k, c in flags.items()], F.count_if(F.col("frequency") == "monthly").alias("monthly"))
    each = F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in flags], F.struct(F.lit("missing_monthly").alias("issue"), F.when(F.col("monthly") == 0, 1).otherwise(0).cast("bigint").alias("n")))
    return counts.select("series_id", F.explode(each).alias("x")).select("series_id", "x.issue", "x.n").where("n > 0")


def month_spine(monthly: DataFrame) -> DataFrame:
    """(series_id, as_of): every month end from a series' first to its last."""
    span = monthly.groupBy("series_id").agg(F.min("as_of").alias("a"), F.max("as_of").alias("b"))
    return span.select("series_id", F.explode(month_ends(F.col("a"), F.col("b"))).alias("as_of"))


def canonical_months(monthly: DataFrame, quarterly: DataFrame, annual: DataFrame) -> DataFrame:
    """The spine with the values of the three frequencies where they fall, and whether the month lacks its own."""
    keys = ["series_id", "as_of"]
    out = month_spine(monthly)
    for name, part in (("monthly", monthly), ("quarterly", quarterly), ("annual", annual)):
        out = out.join(part.select(*keys, F.col("value").alias(f"{name}_value")), keys, "left")
    return out.withColumn("missing_month", F.col("monthly_value").isNull())


def missing_months(monthly: DataFrame) -> DataFrame:
    return month_spine(monthly).join(monthly.select("series_id", "as_of"), ["series_id", "as_of"], "left_anti")


def benchmark_alignment(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Full outer join on the period with a status; months that neither has are absent."""
    keys = ["series_id", "as_of"]
    joined = portfolio.select(*keys, F.col("value").alias("portfolio_value")).join(benchmark.select(*keys, F.col("value").alias("benchmark_value")), keys, "full_outer")
    status = F.when(F.col("portfolio_value").isNull(), "missing_portfolio").when(F.col("benchmark_value").isNull(), "missing_benchmark").otherwise("aligned")
    return joined.withColumn("status", status)


def returns(values: DataFrame) -> DataFrame:
    """value / previous value - 1 within each series; the first period has none."""
    before = F.lag("value").over(Window.partitionBy("series_id").orderBy("as_of"))
    return values.select("series_id", "as_of", (F.col("value") / F.nullif(before, F.lit(0.0)) - 1).alias("value")).where("value is not null")
