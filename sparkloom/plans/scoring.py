"""Queries over scores; suppliers are managers, and their components are arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import scoring
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

FACTORS = (7, 11, 13, 17, 19)
_CLASSES = list(scoring.WEIGHTS)
_WEIGHTS_SQL = "weights(asset_class, component, position, weight) AS (VALUES " + ", ".join(
    f"('{c}', '{k}', {i}, {w}::DOUBLE)" for c, ws in scoring.WEIGHTS.items() for i, (k, w) in enumerate(zip(scoring.COMPONENTS, ws, strict=True))
) + ")"
_CLASS_SQL = "CASE s_nationkey % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES)) + " END"
COMPONENTS_SQL = _WEIGHTS_SQL + ", comps AS (" + " UNION ALL ".join(
    f"SELECT s_suppkey AS manager_id, {_CLASS_SQL} AS asset_class, '{k}' AS component, ((s_suppkey * {f}) % 101) / 100.0::DOUBLE AS value FROM supplier" for k, f in zip(scoring.COMPONENTS, FACTORS, strict=True)
) + """), parts AS (SELECT manager_id, asset_class, component, position, value, weight, round(value * weight, 6) AS contribution FROM comps JOIN weights USING (asset_class, component)),
base AS (SELECT manager_id, asset_class, round(sum(contribution), 6) AS base_score FROM parts GROUP BY 1, 2)"""


def components(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    key = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (F.col("s_nationkey") % 8 + 1).cast("int"))
    each = F.array(*[F.struct(F.lit(k).alias("component"), (((key * f + shift * (key % 7)) % 101) / F.lit(100.0)).alias("value")) for k, f in zip(scoring.COMPONENTS, FACTORS, strict=True)])
    return table(spark, sf_dir, "supplier").select(key.alias("manager_id"), kind.alias("asset_class"), F.explode(each).alias("x")).select("manager_id", "asset_class", "x.component", "x.value")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(components(spark, sf_dir), scoring.weight_table(spark))


@query(f"""WITH {COMPONENTS_SQL}, f AS (SELECT b.*, s.s_suppkey % 23 = 0 AS blocked, CASE WHEN s.s_suppkey % 5 = 0 THEN 0.45::DOUBLE END AS cap FROM base b JOIN supplier s ON s.s_suppkey = b.manager_id)
SELECT manager_id, asset_class, base_score, CASE WHEN blocked THEN 0.0::DOUBLE WHEN cap < base_score THEN cap ELSE base_score END AS final_score,
  blocked OR coalesce(cap < base_score, false) AS red_flag FROM f""")
def score_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    flags = table(spark, sf_dir, "supplier").select(key.alias("manager_id"), (key % 23 == 0).alias("blocked"), F.when(key % 5 == 0, 0.45).alias("cap"))
    return scoring.scores(components(spark, sf_dir), scoring.weight_table(spark), flags)


@query(f"""WITH {COMPONENTS_SQL} SELECT p.manager_id, p.asset_class, round(sum(contribution), 6) AS total,
  string_agg(component || '=' || printf('%.6f', contribution), ';' ORDER BY position) AS parts, any_value(b.base_score) AS base_score, abs(round(sum(contribution), 6) - any_value(b.base_score)) <= 1e-6 AS reconciles
FROM parts p JOIN base b USING (manager_id) GROUP BY 1, 2""")
def score_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.explanation(components(spark, sf_dir), scoring.weight_table(spark))


@query(f"""WITH {COMPONENTS_SQL} SELECT manager_id, asset_class, base_score, CAST(row_number() OVER (PARTITION BY asset_class ORDER BY base_score DESC, manager_id) AS INTEGER) AS class_rank,
  CAST(row_number() OVER (ORDER BY base_score DESC, manager_id) AS INTEGER) AS overall_rank FROM base""")
def score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_class = scoring.ranked(base_scores(spark, sf_dir)).withColumnRenamed("rank", "class_rank")
    return scoring.ranked(in_class, None).select("manager_id", "asset_class", "base_score", "class_rank", F.col("rank").alias("overall_rank"))


@query(f"""WITH {COMPONENTS_SQL} SELECT a.manager_id, a.asset_class, a.base_score, round((count(*) FILTER (b.base_score < a.base_score) + 0.5::DOUBLE * count(*) FILTER (b.base_score = a.base_score)) / count(*) * 100, 6) AS percentile, count(*) AS peers
FROM base a JOIN base b USING (asset_class) GROUP BY 1, 2, 3""")
def score_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.percentile_ranks(base_scores(spark, sf_dir))
    return out.select("manager_id", "asset_class", "base_score", F.round("percentile", 6).alias("percentile"), "peers")


@query(f"""WITH {COMPONENTS_SQL}, pw AS (SELECT asset_class, component, greatest(0.0::DOUBLE, weight + CASE component WHEN 'transparency' THEN 0.1::DOUBLE WHEN 'team_experience' THEN -0.05::DOUBLE ELSE 0 END) AS w FROM weights),
nw AS (SELECT asset_class, component, round(w / sum(w) OVER (PARTITION BY asset_class), 12) AS w FROM pw),
after AS (SELECT manager_id, asset_class, round(sum(round(value * w, 6)), 6) AS score_after FROM comps JOIN nw USING (asset_class, component) GROUP BY 1, 2),
r AS (SELECT asset_class, manager_id, base_score AS score_before, score_after, CAST(row_number() OVER (PARTITION BY asset_class ORDER BY base_score DESC, manager_id) AS INTEGER) AS rank_before,
  CAST(row_number() OVER (PARTITION BY asset_class ORDER BY score_after DESC, manager_id) AS INTEGER) AS rank_after FROM base JOIN after USING (asset_class, manager_id))
SELECT *, round(score_after - score_before, 6) AS score_delta, rank_after - rank_before AS rank_delta FROM r""")
def score_weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sensitivity(components(spark, sf_dir), scoring.weight_table(spark), {"transparency": 0.1, "team_experience": -0.05})


_MOVED = "comps2 AS (" + " UNION ALL ".join(
    f"SELECT s_suppkey AS manager_id, {_CLASS_SQL} AS asset_class, '{k}' AS component, ((s_suppkey * {f} + 5 * (s_suppkey % 7)) % 101) / 100.0::DOUBLE AS value FROM supplier WHERE s_suppkey % 29 <> 0" for k, f in zip(scoring.COMPONENTS, FACTORS, strict=True)
) + "), base2 AS (SELECT manager_id, asset_class, round(sum(round(value * weight, 6)), 6) AS base_score FROM comps2 JOIN weights USING (asset_class, component) GROUP BY 1, 2)"


@query(f"""WITH {COMPONENTS_SQL}, {_MOVED},
a AS (SELECT asset_class, manager_id, base_score AS score_a, CAST(row_number() OVER (PARTITION BY asset_class ORDER BY base_score DESC, manager_id) AS INTEGER) AS rank_a FROM base),
b AS (SELECT asset_class, manager_id, base_score AS score_b, CAST(row_number() OVER (PARTITION BY asset_class ORDER BY base_score DESC, manager_id) AS INTEGER) AS rank_b FROM base2),
j AS (SELECT asset_class, manager_id, score_a, rank_a, score_b, rank_b, CASE WHEN score_a IS NULL THEN 'only_candidate' WHEN score_b IS NULL THEN 'only_baseline' WHEN abs(score_b - score_a) > 0.05 THEN 'score' WHEN abs(rank_b - rank_a) > 2 THEN 'rank' END AS alert FROM a FULL JOIN b USING (asset_class, manager_id))
SELECT * FROM j WHERE alert IS NOT NULL""")
def score_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = scoring.scores(components(spark, sf_dir, 5).where(F.col("manager_id") % 29 != 0), scoring.weight_table(spark))
    return scoring.drift(base_scores(spark, sf_dir), moved)


@query(f"""WITH {COMPONENTS_SQL} SELECT asset_class, count(*) AS n, CAST(sum(CAST(base_score AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS mean, round(coalesce(stddev_samp(base_score), 0), 6) AS stddev, min(base_score) AS least,
  round(quantile_cont(base_score, 0.5), 6) AS p50, round(quantile_cont(base_score, 0.9), 6) AS p90, max(base_score) AS most FROM base GROUP BY 1""")
def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.calibration(base_scores(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("stddev", "p50", "p90")})


@query(f"""WITH {COMPONENTS_SQL}, kept AS (SELECT manager_id, asset_class, CASE WHEN manager_id % 10 = 3 AND component = 'transparency' THEN 'clarity' ELSE component END AS component FROM comps WHERE NOT (manager_id % 10 = 4 AND component = 'team_experience'))
SELECT s.manager_id, s.asset_class, w.component, 'missing' AS issue FROM (SELECT DISTINCT manager_id, asset_class FROM kept) s JOIN weights w USING (asset_class) ANTI JOIN kept k ON k.manager_id = s.manager_id AND k.component = w.component
UNION ALL SELECT k.manager_id, k.asset_class, k.component, 'unknown' FROM kept k ANTI JOIN weights w ON w.asset_class = k.asset_class AND w.component = k.component""")
def score_alignment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("manager_id"), F.col("component")
    kept = components(spark, sf_dir).where(~((key % 10 == 4) & (name == "team_experience")))
    return scoring.alignment_issues(kept.withColumn("component", F.when((key % 10 == 3) & (name == "transparency"), "clarity").otherwise(name)), scoring.weight_table(spark))


@query("""WITH l AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' Long-Short Equity ' WHEN 1 THEN 'CTA' WHEN 2 THEN 'Multi Strategy' WHEN 3 THEN 'macro' WHEN 4 THEN 'Event-Driven' ELSE c_mktsegment END AS label FROM customer),
p AS (SELECT c_custkey, label, replace(replace(lower(trim(label)), '-', '_'), ' ', '_') AS plain FROM l)
SELECT c_custkey, label, CASE plain WHEN 'long_short_equity' THEN 'equity_market_neutral' WHEN 'cta' THEN 'trend_following' WHEN 'multi_strategy' THEN 'multi_strat' WHEN 'macro' THEN 'macro' WHEN 'event_driven' THEN 'activist' END AS asset_class FROM p""")
def asset_class_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("c_mktsegment")
    for k, text in enumerate((" Long-Short Equity ", "CTA", "Multi Strategy", "macro", "Event-Driven")):
        label = F.when(F.col("c_custkey") % 6 == k, text).otherwise(label)
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label")).withColumn("asset_class", scoring.asset_class(F.col("label")))
