"""Weighted scores by asset class, their explanation, ranks, percentiles, sensitivity, drift and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Components in order, weights by asset class, and other names of the classes.
COMPONENTS = ("performance_consistency", "risk_adjusted_returns", "operational_quality", "transparency", "team_experience")
WEIGHTS = {
    "equity_market_neutral": (0.30, 0.25, 0.15, 0.15, 0.15),
    "quant": (0.27, 0.30, 0.12, 0.16, 0.15),
    "multi_strat": (0.27, 0.23, 0.20, 0.12, 0.18),
    "credit_long_short": (0.25, 0.30, 0.20, 0.15, 0.10),
    "macro": (0.28, 0.27, 0.15, 0.10, 0.20),
    "trend_following": (0.22, 0.33, 0.15, 0.15, 0.15),
    "credit_relative_value": (0.24, 0.26, 0.22, 0.14, 0.14),
    "activist": (0.24, 0.21, 0.20, 0.20, 0.15),
}
ALIASES = {
    "equity": "equity_market_neutral",
    "equity_l_s": "equity_market_neutral",
    "long_short_equity": "equity_market_neutral",
    "equity_long_short": "equity_market_neutral",
    "quantitative": "quant",
    "multi_strategy": "multi_strat",
    "multi_asset": "multi_strat",
    "credit": "credit_long_short",
    "credit_ls": "credit_long_short",
    "credit_l_s": "credit_long_short",
    "cta": "trend_following",
    "managed_futures": "trend_following",
    "relative_value_credit": "credit_relative_value",
    "distressed_credit": "credit_relative_value",
    "event_driven": "activist",
}


def weight_table(spark: SparkSession) -> DataFrame:
    """(asset_class, component, position, weight): forty rows."""
    rows = [(c, k, i, w) for c, ws in WEIGHTS.items() for i, (k, w) in enumerate(zip(COMPONENTS, ws, strict=True))]
    return spark.createDataFrame(rows, "asset_class string, component string, position int, weight double")


def weight_issues(weights: DataFrame) -> DataFrame:
    """Asset classes whose weights miss or add components, leave [0, 1] or do not sum to one."""
    known = F.col("component").isin(*COMPONENTS)
    checked = weights.groupBy("asset_class").agg(
        F.sum("weight").alias("total"), F.countDistinct(F.when(known, F.col("component"))).alias("known"), F.count_if(~known).alias("unknown"), F.count_if(~F.col("weight").between(0, 1)).alias("outside")
    )
    return checked.where((F.abs(F.col("total") - 1) > 1e-9) | (F.col("known") < len(COMPONENTS)) | (F.col("unknown") > 0) | (F.col("outside") > 0))


def asset_class(label: Column) -> Column:
    """The canonical class of a label, null if there is none."""
    plain = F.translate(F.lower(F.trim(label)), "- ", "__")
    known = F.create_map(*[F.lit(x) for kv in ({k: k for k in WEIGHTS} | ALIASES).items() for x in kv])
    return F.try_element_at(known, plain)


def contributions(components: DataFrame, weights: DataFrame) -> DataFrame:
    """components(manager_id, asset_class, component, value) with weight and contribution; the weights are a small fixed table."""
    return components.join(F.broadcast(weights), ["asset_class", "component"]).withColumn("contribution", F.round(F.col("value") * F.col("weight"), 6))


def alignment_issues(components: DataFrame, weights: DataFrame) -> DataFrame:
    """Components that a submission lacks and those that its class does not know."""
    submitted = components.select("manager_id", "asset_class").distinct()
    wanted = submitted.join(F.broadcast(weights.select("asset_class", "component")), "asset_class")
    missing = wanted.join(components, ["manager_id", "asset_class", "component"], "left_anti").withColumn("issue", F.lit("missing"))
    unknown = components.join(F.broadcast(weights), ["asset_class", "component"], "left_anti").withColumn("issue", F.lit("unknown"))
    columns = ["manager_id", "asset_class", "component", "issue"]
    return missing.select(columns).unionByName(unknown.select(columns))


def scores(components: DataFrame, weights: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Base score by manager, and the final one under red flags (manager_id, blocked, cap): blocked is 0, a cap only lowers."""
    base = contributions(components, weights).groupBy("manager_id", "asset_class").agg(F.round(F.sum("contribution"), 6).alias("base_score"))
    if flags is None:
        return base.withColumn("final_score", F.col("base_score")).withColumn("red_flag", F.lit(False))
    cap = F.round("cap", 6)
    final = F.when(F.col("blocked"), 0.0).when(cap < F.col("base_score"), cap).otherwise(F.col("base_score"))
    out = base.join(flags, "manager_id", "left").withColumn("final_score", final)
    return out.select("manager_id", "asset_class", "base_score", "final_score", (F.coalesce("blocked", F.lit(False)) | (F.col("final_score") < F.col("base_score"))).alias("red_flag"))


def ranked(scored: DataFrame, by: str | None = "asset_class", score: str = "base_score") -> DataFrame:
    """Rank by falling score and then id, within the classes or overall.

    The overall rank needs one order of all rows; it is taken within score ranges, and each range
    starts after the rows of the higher ones.
    """
    order = [F.col(score).desc(), F.col("manager_id")]
    if by:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    bucket = F.floor(F.col(score) * 1000)
    sizes = scored.groupBy(bucket.alias("bucket")).count()
    above = sizes.alias("a").join(sizes.alias("b"), F.col("b.bucket") > F.col("a.bucket"), "left").groupBy("a.bucket").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("above"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return scored.withColumn("bucket", bucket).join(above, "bucket").withColumn("rank", (own + F.col("above")).cast("int")).drop("bucket", "above")


def percentile_ranks(scored: DataFrame, by: str = "asset_class", score: str = "base_score") -> DataFrame:
    """Midpoint percentile within the class: those below and half of those equal.

    Scores have six places, so ties are exact, and a range frame needs no pairs of rows.
    """
    steps = F.round(F.col(score) * 1_000_000).cast("bigint")
    w = Window.partitionBy(by).orderBy(steps)
    peers = F.count("*").over(Window.partitionBy(by))
    below = F.coalesce(F.count("*").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    equal = F.count("*").over(w.rangeBetween(0, 0))
    return scored.withColumns({"percentile": (below + 0.5 * equal) / peers * 100, "peers": peers})


def perturbed(weights: DataFrame, deltas: dict[str, float]) -> DataFrame:
    """Weights plus the deltas, not below zero, scaled to one again."""
    delta = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in deltas.items() for x in kv]), F.col("component")), F.lit(0.0))
    moved = weights.withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") + delta))
    return moved.withColumn("weight", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("asset_class")), 12))


def sensitivity(components: DataFrame, weights: DataFrame, deltas: dict[str, float]) -> DataFrame:
    """Score and rank in the class before and after the weights move."""
    before = ranked(scores(components, weights)).select("asset_class", "manager_id", F.col("base_score").alias("score_before"), F.col("rank").alias("rank_before"))
    after = ranked(scores(components, perturbed(weights, deltas))).select("asset_class", "manager_id", F.col("base_score").alias("score_after"), F.col("rank").alias("rank_after"))
    both = before.join(after, ["asset_class", "manager_id"])
    return both.withColumns({"score_delta": F.round(F.col("score_after") - F.col("score_before"), 6), "rank_delta": F.col("rank_after") - F.col("rank_before")})


def drift(baseline: DataFrame, candidate: DataFrame, score_limit: float = 0.05, rank_limit: int = 2) -> DataFrame:
    """Managers whose score or rank moved by more than the limits, and those that only one side has."""
    keys = ["asset_class", "manager_id"]
    a = ranked(baseline).select(*keys, F.col("base_score").alias("score_a"), F.col("rank").alias("rank_a"))
    b = ranked(candidate).select(*keys, F.col("base_score").alias("score_b"), F.col("rank").alias("rank_b"))
    both = a.join(b, keys, "full_outer")
    kind = (
        F.when(F.col("score_a").isNull(), "only_candidate")
        .when(F.col("score_b").isNull(), "only_baseline")
        .when(F.abs(F.col("score_b") - F.col("score_a")) > score_limit, "score")
        .when(F.abs(F.col("rank_b") - F.col("rank_a")) > rank_limit, "rank")
    )
    return both.withColumn("alert", kind).where("alert is not null")


def calibration(scored: DataFrame, by: str = "asset_class", score: str = "base_score") -> DataFrame:
    """Distribution of the scores of each class; the deviation of one score is 0. Scores have six places, so their sum is exact."""
    return scored.groupBy(by).agg(
        F.count("*").alias("n"),
        (F.sum(F.col(score).cast("decimal(18,6)")).cast("double") / F.count("*")).alias("mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("stddev"),
        F.min(score).alias("least"),
        F.percentile(score, 0.5).alias("p50"),
        F.percentile(score, 0.9).alias("p90"),
        F.max(score).alias("most"),
    )


def explanation(components: DataFrame, weights: DataFrame) -> DataFrame:
    """Contributions in component order with their total, and whether they add up to the base score."""
    parts = contributions(components, weights)
    base = scores(components, weights).select("manager_id", "base_score")
    totals = parts.groupBy("manager_id", "asset_class").agg(
        F.round(F.sum("contribution"), 6).alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "component", "contribution"))), lambda x: F.concat_ws("=", x["component"], F.format_string("%.6f", x["contribution"]))), ";").alias("parts"),
    )
    return totals.join(base, "manager_id").withColumn("reconciles", F.abs(F.col("total") - F.col("base_score")) <= 1e-6)
