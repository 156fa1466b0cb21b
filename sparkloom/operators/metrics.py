"""Risk and benchmark metrics of monthly return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-12
PER_YEAR = 12


def _guarded(value: Column, spread: Column) -> Column:
    return F.when(F.abs(spread) > FLAT, value)


def risk_metrics(monthly: DataFrame, annual_risk_free: float = 0.0) -> DataFrame:
    """Volatility, Sharpe and Sortino by series in one aggregation; null where the data do not suffice."""
    excess = F.col("value") - annual_risk_free / PER_YEAR
    spread = F.stddev_samp(excess)
    down = F.sqrt(F.avg(F.pow(F.least(F.lit(0.0), excess), 2)))
    year = PER_YEAR**0.5
    out = monthly.groupBy("series_id").agg(
        F.count("*").alias("observations"),
        (F.stddev_samp("value") * year).alias("volatility"),
        F.when(F.count("*") > 1, _guarded(F.try_divide(F.avg(excess), spread) * year, spread)).alias("sharpe"),
        F.when(F.count("*") > 1, _guarded(F.try_divide(F.avg(excess), down) * year, down)).alias("sortino"),
    )
    names = ("volatility", "sharpe", "sortino")
    return out.withColumn("insufficient", F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in names])), ","))


def max_drawdown(monthly: DataFrame) -> DataFrame:
    """The largest fall of compounded equity from its peak, starting at one; null for under two months.

    Equity is a running product, so the months of a series are folded in order; a series has few.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("as_of", "value"))), lambda x: x["value"])
    start = F.struct(F.lit(1.0).alias("equity"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, r: Column) -> Column:
        equity = s["equity"] * (1 + r)
        peak = F.greatest(s["peak"], equity)
        return F.struct(equity.alias("equity"), peak.alias("peak"), F.greatest(s["worst"], 1 - equity / peak).alias("worst"))

    grouped = monthly.groupBy("series_id").agg(ordered.alias("r"))
    worst = F.aggregate("r", start, step, lambda s: s["worst"])
    return grouped.select("series_id", F.size("r").cast("bigint").alias("observations"), F.when(F.size("r") > 1, worst).alias("max_drawdown"))


def benchmark_metrics(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Information ratio and correlation over the months that both series have."""
    both = portfolio.select("series_id", "as_of", F.col("value").alias("p")).join(benchmark.select("series_id", "as_of", F.col("value").alias("b")), ["series_id", "as_of"])
    active = F.col("p") - F.col("b")
    spread = F.stddev_samp(active)
    sds = (F.stddev_samp("p"), F.stddev_samp("b"))
    return both.groupBy("series_id").agg(
        F.count("*").alias("observations"),
        F.when(F.count("*") > 1, _guarded(F.try_divide(F.avg(active), spread) * PER_YEAR**0.5, spread)).alias("information_ratio"),
        F.when((sds[0] > FLAT) & (sds[1] > FLAT), F.try_divide(F.covar_samp("p", "b"), sds[0] * sds[1])).alias("correlation"),
    )


def equity_curve(monthly: DataFrame) -> DataFrame:
    """Running equity and peak by window, for returns above -1."""
    w = Window.partitionBy("series_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    equity = monthly.withColumn("equity", F.exp(F.sum(F.log1p("value")).over(w)))
    return equity.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
