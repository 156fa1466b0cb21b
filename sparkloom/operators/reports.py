"""Reports: metric roll-ups, intervals, top lists, catalogue differences, lineage and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WILSON_Z = 1.96


def wilson_interval(successes: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; 0 and 0 without trials."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    scale = 1 + z * z / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda c: F.when(n > 0, c).otherwise(0.0)
    return bound((middle - half) / scale), bound((middle + half) / scale)


def metric_rollup(points: DataFrame) -> DataFrame:
    """Count, sum and nearest-rank 95th percentile by name and tags, with totals by name and overall."""
    return points.rollup("name", "tag").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.percentile_disc(0.95).within_group("value").alias("p95") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


def top_per_group(rows: DataFrame, group: str, *order: Column, n: int = 3) -> DataFrame:
    """The first n of each group; a top list is the feature."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def catalog_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    added = after.select(keys).distinct().join(before, keys, "left_anti").withColumn("change", F.lit("added"))
    removed = before.select(keys).distinct().join(after, keys, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def history_upsert(history: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The union with one row for each key: of incoming if there, else of history; by order among equals."""
    both = history.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col("_new").desc(), F.col(order).desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def lineage(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Each document with its fields as text, in order: doc:key:pN; documents without fields stay."""
    item = F.struct("page", "key", F.concat(F.col("document_id").cast("string"), F.lit(":"), F.col("key"), F.lit(":p"), F.col("page").cast("string")).alias("ref"))
    refs = fields.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["ref"]), ";").alias("refs"), F.count("*").alias("n_fields"))
    joined = documents.join(refs, "document_id", "left")
    return joined.select("document_id", F.coalesce("n_fields", F.lit(0)).cast("bigint").alias("n_fields"), F.coalesce("refs", F.lit("")).alias("refs"))


def verdicts(votes: DataFrame) -> DataFrame:
    """Worst and majority verdict by item of votes(item_id, severity), and whether they are split; ties go to the worse."""
    counts = votes.groupBy("item_id", "severity").count()
    return counts.groupBy("item_id").agg(F.max("severity").alias("worst"), F.max(F.struct("count", "severity"))["severity"].alias("majority"), (F.count("*") > 1).alias("split"))
