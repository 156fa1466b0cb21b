"""Queries over return series; a nation's monthly order totals are its series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.dates import DATE_FORMATS, month_end, parse_date, quarter_end, year_end
from sparkloom.operators import conflict, metrics, timeseries
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

NATION_MONTH_SQL = """nation_month AS (
  SELECT CAST(c_nationkey AS INTEGER) AS series_id, last_day(CAST(o_orderdate AS DATE)) AS as_of, round(sum(o_totalprice), 2) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), ret AS (
  SELECT * FROM (SELECT series_id, as_of, value / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY as_of), 0) - 1 AS value FROM nation_month) WHERE value IS NOT NULL
), bench_month AS (
  SELECT as_of, round(sum(value), 2) AS value FROM nation_month GROUP BY 1
), bench AS (
  SELECT * FROM (SELECT as_of, value / nullif(lag(value) OVER (ORDER BY as_of), 0) - 1 AS value FROM bench_month) WHERE value IS NOT NULL
)"""


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").cast("int").alias("series_id"), month_end(F.col("o_orderdate").cast("date")).alias("as_of")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def nation_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.returns(nation_month(spark, sf_dir))


def benchmark_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returns of all nations' total, for every nation."""
    months = nation_month(spark, sf_dir)
    total = months.groupBy("as_of").agg(F.round(F.sum("value"), 2).alias("value")).withColumn("series_id", F.lit(0))
    of_total = timeseries.returns(total).drop("series_id")
    return months.select("series_id").distinct().join(of_total)


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, last_day(CAST(o_orderdate AS DATE)) AS month_end,
  last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end, make_date(year(o_orderdate), 12, 31) AS year_end FROM orders""")
def ts_period_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", month_end(day).alias("month_end"), quarter_end(day).alias("quarter_end"), year_end(day).alias("year_end"))


@query(f"""WITH {NATION_MONTH_SQL}, span AS (SELECT series_id, min(as_of) a, max(as_of) b FROM nation_month GROUP BY 1),
spine AS (SELECT series_id, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS as_of FROM span),
q AS (SELECT series_id, last_day(CAST(date_trunc('quarter', as_of) AS DATE) + INTERVAL 2 MONTH) AS as_of, round(sum(value), 2) AS value FROM nation_month GROUP BY 1, 2),
y AS (SELECT series_id, make_date(year(as_of), 12, 31) AS as_of, round(sum(value), 2) AS value FROM nation_month GROUP BY 1, 2)
SELECT s.series_id, s.as_of, m.value AS monthly_value, q.value AS quarterly_value, y.value AS annual_value, m.value IS NULL AS missing_month
FROM spine s LEFT JOIN nation_month m USING (series_id, as_of) LEFT JOIN q USING (series_id, as_of) LEFT JOIN y USING (series_id, as_of)""")
def ts_canonical_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = nation_month(spark, sf_dir)

    def summed(end: F.Column) -> DataFrame:
        return months.groupBy("series_id", end.alias("as_of")).agg(F.round(F.sum("value"), 2).alias("value"))

    return timeseries.canonical_months(months, summed(quarter_end(F.col("as_of"))), summed(year_end(F.col("as_of"))))


@query(f"""WITH {NATION_MONTH_SQL}, span AS (SELECT series_id, min(as_of) a, max(as_of) b FROM nation_month GROUP BY 1),
spine AS (SELECT series_id, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS as_of FROM span)
SELECT series_id, as_of FROM spine ANTI JOIN nation_month USING (series_id, as_of)""")
def ts_missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.missing_months(nation_month(spark, sf_dir))


@query(f"""WITH {NATION_MONTH_SQL}, agg AS (
  SELECT series_id, count(*) AS observations, stddev_samp(value) AS sd, avg(value) AS mean, sqrt(avg(pow(least(0, value), 2))) AS down FROM ret GROUP BY 1)
SELECT series_id, observations, round(sd * sqrt(12), 6) AS volatility, round(CASE WHEN observations > 1 AND sd > 1e-12 THEN mean / sd * sqrt(12) END, 6) AS sharpe,
  round(CASE WHEN observations > 1 AND down > 1e-12 THEN mean / down * sqrt(12) END, 6) AS sortino,
  concat_ws(',', CASE WHEN sd IS NULL THEN 'volatility' END, CASE WHEN NOT coalesce(observations > 1 AND sd > 1e-12, false) THEN 'sharpe' END, CASE WHEN NOT coalesce(observations > 1 AND down > 1e-12, false) THEN 'sortino' END) AS insufficient
FROM agg""")
def ts_risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.risk_metrics(nation_returns(spark, sf_dir))
    return out.select("series_id", "observations", *[F.round(c, 6).alias(c) for c in ("volatility", "sharpe", "sortino")], "insufficient")


@query(f"""WITH {NATION_MONTH_SQL}, eq AS (SELECT series_id, as_of, product(1 + value) OVER (PARTITION BY series_id ORDER BY as_of) AS equity FROM ret),
pk AS (SELECT series_id, equity, greatest(1.0, max(equity) OVER (PARTITION BY series_id ORDER BY as_of)) AS peak FROM eq)
SELECT series_id, count(*) AS observations, round(CASE WHEN count(*) > 1 THEN greatest(0.0, max(1 - equity / peak)) END, 6) AS max_drawdown FROM pk GROUP BY 1""")
def ts_max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.max_drawdown(nation_returns(spark, sf_dir))
    return out.withColumn("max_drawdown", F.round("max_drawdown", 6))


@query(f"""WITH {NATION_MONTH_SQL}, eq AS (SELECT series_id, as_of, product(1 + value) OVER (PARTITION BY series_id ORDER BY as_of) AS equity FROM ret)
SELECT series_id, as_of, round(equity, 4) AS equity, round(greatest(1.0, max(equity) OVER (PARTITION BY series_id ORDER BY as_of)), 4) AS peak FROM eq""")
def ts_equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.equity_curve(nation_returns(spark, sf_dir))
    return out.select("series_id", "as_of", F.round("equity", 4).alias("equity"), F.round("peak", 4).alias("peak"))


@query(f"""WITH {NATION_MONTH_SQL}, j AS (SELECT series_id, ret.value AS p, bench.value AS b FROM ret JOIN bench USING (as_of)), agg AS (
  SELECT series_id, count(*) AS observations, avg(p - b) AS mean, stddev_samp(p - b) AS sd, stddev_samp(p) AS sp, stddev_samp(b) AS sb, covar_samp(p, b) AS cov FROM j GROUP BY 1)
SELECT series_id, observations, round(CASE WHEN observations > 1 AND sd > 1e-12 THEN mean / sd * sqrt(12) END, 6) AS information_ratio,
  round(CASE WHEN sp > 1e-12 AND sb > 1e-12 THEN cov / (sp * sb) END, 6) AS correlation FROM agg""")
def ts_benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.benchmark_metrics(nation_returns(spark, sf_dir), benchmark_returns(spark, sf_dir))
    return out.select("series_id", "observations", F.round("information_ratio", 6).alias("information_ratio"), F.round("correlation", 6).alias("correlation"))


@query(f"""WITH {NATION_MONTH_SQL}, p AS (SELECT * FROM nation_month WHERE month(as_of) % 5 <> 0), b AS (SELECT series_id, as_of, value * 2 AS value FROM nation_month WHERE month(as_of) % 4 <> 0)
SELECT series_id, as_of, p.value AS portfolio_value, b.value AS benchmark_value,
  CASE WHEN p.value IS NULL THEN 'missing_portfolio' WHEN b.value IS NULL THEN 'missing_benchmark' ELSE 'aligned' END AS status FROM p FULL JOIN b USING (series_id, as_of)""")
def ts_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = nation_month(spark, sf_dir)
    return timeseries.benchmark_alignment(months.where(F.month("as_of") % 5 != 0), months.where(F.month("as_of") % 4 != 0).withColumn("value", F.col("value") * 2))


ORDER_POINTS_SQL = """points AS (SELECT o_custkey AS series_id, CASE o_orderkey % 5 WHEN 0 THEN 'quarterly' WHEN 1 THEN 'annual' WHEN 2 THEN 'weekly' ELSE 'monthly' END AS frequency,
  CAST(o_orderdate AS DATE) AS as_of, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS value, o_orderkey AS ord FROM orders)"""


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    frequency = F.when(key % 5 == 0, "quarterly").when(key % 5 == 1, "annual").when(key % 5 == 2, "weekly").otherwise("monthly")
    value = F.when(key % 97 != 0, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series_id"), frequency.alias("frequency"), F.col("o_orderdate").cast("date").alias("as_of"), value.alias("value"), key.alias("ord"))


@query(f"""WITH {ORDER_POINTS_SQL}, s AS (SELECT *, CASE frequency WHEN 'monthly' THEN last_day(as_of) WHEN 'quarterly' THEN last_day(CAST(date_trunc('quarter', as_of) AS DATE) + INTERVAL 2 MONTH) WHEN 'annual' THEN make_date(year(as_of), 12, 31) END AS period FROM points),
f AS (SELECT *, count(*) OVER (PARTITION BY series_id, frequency, period) > 1 AS dup, coalesce(period < lag(period) OVER (PARTITION BY series_id, frequency ORDER BY ord), false) AS ooo FROM s),
c AS (SELECT series_id, count(*) FILTER (dup) AS duplicate_period, count(*) FILTER (ooo) AS out_of_order, count(*) FILTER (value IS NULL) AS not_finite, count(*) FILTER (period IS NULL) AS unknown_frequency,
  CASE WHEN count(*) FILTER (frequency = 'monthly') = 0 THEN 1 ELSE 0 END AS missing_monthly FROM f GROUP BY 1)
SELECT series_id, issue, CAST(n AS BIGINT) AS n FROM (UNPIVOT c ON duplicate_period, out_of_order, not_finite, unknown_frequency, missing_monthly INTO NAME issue VALUE n) WHERE n > 0""")
def ts_validate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.series_issues(order_points(spark, sf_dir))


SOURCES_SQL = """a AS (SELECT CAST(c_nationkey AS INTEGER) AS series_id, last_day(CAST(o_orderdate AS DATE)) AS as_of, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0 GROUP BY 1, 2),
b AS (SELECT CAST(c_nationkey AS INTEGER) AS series_id, last_day(CAST(o_orderdate AS DATE)) AS as_of, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0 GROUP BY 1, 2)"""


def two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))

    def part(modulus: int) -> DataFrame:
        rows = joined.where(F.col("o_orderkey") % modulus != 0)
        return rows.groupBy(F.col("c_nationkey").cast("int").alias("series_id"), month_end(F.col("o_orderdate").cast("date")).alias("as_of")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    return part(7), part(11)


@query(f"""WITH {SOURCES_SQL} SELECT series_id, as_of, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'preferred' ELSE 'other' END AS source FROM a FULL JOIN b USING (series_id, as_of)""")
def perf_conflict_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.resolve(*two_sources(spark, sf_dir))


@query(f"""WITH {SOURCES_SQL} SELECT series_id, as_of, a.value AS a, b.value AS b, round(abs(a.value - b.value), 4) AS abs_diff,
  round(abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-12) * 100, 6) AS pct_diff, abs(a.value - b.value) > 1e-12 AS is_conflict FROM a JOIN b USING (series_id, as_of)""")
def perf_conflict_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.audit(*two_sources(spark, sf_dir)).withColumns({"abs_diff": F.round("abs_diff", 4), "pct_diff": F.round("pct_diff", 6)})


@query(f"""WITH {SOURCES_SQL}, j AS (SELECT series_id, abs(a.value - b.value) > 1e-12 AS c FROM a JOIN b USING (series_id, as_of)),
s AS (SELECT series_id, count(*) AS overlap, count(*) FILTER (c) AS conflicts FROM j GROUP BY 1)
SELECT series_id, overlap, conflicts, round(conflicts * 100.0::DOUBLE / overlap, 6) AS conflict_percent, conflicts * 100.0::DOUBLE / overlap > 5.0 AS escalate FROM s""")
def perf_conflict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.conflict_stats(*two_sources(spark, sf_dir)).withColumn("conflict_percent", F.round("conflict_percent", 6))


_PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "yyyyMMdd")


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'n/a' END AS raw FROM orders)
SELECT o_orderkey, raw, CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y/%m/%d'), try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%Y%m%d')) AS DATE) AS parsed FROM t""")
def date_parse_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.lit("n/a")
    for k, pattern in enumerate(_PATTERNS):
        raw = F.when(kind == k, F.date_format(day.cast("date"), pattern)).otherwise(raw)
    assert len(DATE_FORMATS) == len(_PATTERNS)
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("parsed", parse_date(F.col("raw")))


@query(f"""WITH {SOURCES_SQL}, u AS (SELECT as_of FROM a UNION SELECT as_of FROM b), i AS (SELECT as_of FROM a INTERSECT SELECT as_of FROM b), e AS (SELECT as_of FROM a EXCEPT SELECT as_of FROM b WHERE month(as_of) > 3)
SELECT 'union' AS op, as_of FROM u UNION ALL SELECT 'intersect', as_of FROM i UNION ALL SELECT 'except', as_of FROM e""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.select("as_of") for x in two_sources(spark, sf_dir))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b.where(F.month("as_of") > 3))}
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("op"), "as_of")
        out = rows if out is None else out.unionByName(rows)
    return out
