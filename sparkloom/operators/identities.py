"""Identities, stored records and document types: names, merges, invariants, ids, ordered scans, pointers, term matches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.dates import utc_timestamp
from sparkloom.functions.strings import folded

# The fields that a provenance pointer may name.
POINTER_FIELDS = ("document_id", "fund_id", "file_name", "file_hash", "received_at", "version_date", "source_channel", "created_at")
ZONE = r"(?:Z|[+-]\d{2}:?\d{2})$"


def plain_name(name: Column) -> Column:
    """NFKC, case folded, single spaces."""
    return F.trim(F.regexp_replace(folded(name), r"\s+", " "))


def merged_funds(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Funds by fund_id: what is new and not null wins, but the name stays; new funds are added."""
    new = incoming.select("fund_id", *[F.col(c).alias(f"_{c}") for c in ("firm_id", "fund_name", "strategy", "asset_class")])
    both = existing.join(new, "fund_id", "full_outer")
    return both.select("fund_id", F.coalesce(F.nullif("_firm_id", F.lit("")), "firm_id").alias("firm_id"), F.coalesce("fund_name", "_fund_name").alias("fund_name"), F.coalesce("_strategy", "strategy").alias("strategy"), F.coalesce("_asset_class", "asset_class").alias("asset_class"))


def document_collisions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents that arrive again with another fund, hash or channel: (document_id, mismatches)."""
    names = ("fund_id", "file_hash", "source_channel")
    both = existing.join(incoming.select("document_id", *[F.col(c).alias(f"_{c}") for c in names]), "document_id")
    odd = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("None")), F.lit("->"), F.coalesce(F.col(f"_{c}"), F.lit("None")))) for c in names]))
    return both.select("document_id", F.array_join(odd, ", ").alias("mismatches")).where("mismatches <> ''")


def document_ids(packages: DataFrame) -> DataFrame:
    """The id of every file of packages(package_id, files array<struct<document_id>>), {package}:doc:{i} where none is given, and whether it repeats."""
    each = packages.select("package_id", F.posexplode("files").alias("i", "f"))
    own = F.coalesce(F.nullif(F.col("f.document_id"), F.lit("")), F.concat_ws(":doc:", F.col("package_id").cast("string"), F.col("i").cast("string")))
    named = each.select("package_id", "i", own.alias("document_id"))
    earlier = F.row_number().over(Window.partitionBy("package_id", "document_id").orderBy("i")) > 1
    return named.withColumn("duplicate", earlier)


def scoped_matches(names: DataFrame, entities: DataFrame, scope: str) -> DataFrame:
    """names(name_id, scope, key) to entities(entity_id, scope, key) of the same scope: matches, and the entity if there is one."""
    groups = entities.select(scope, "key", "entity_id").distinct().groupBy(scope, "key").agg(F.count("*").alias("matches"), F.min("entity_id").alias("entity_id"))
    joined = names.join(groups, [scope, "key"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return joined.select("name_id", scope, "key", "matches", F.when(F.col("matches") == 1, F.col("entity_id")).alias("entity_id"))


def utc_text(text: Column) -> Column:
    """UTC seconds with +00:00; a time without a zone is UTC."""
    return F.regexp_replace(F.date_format(utc_timestamp(text), "yyyy-MM-dd'T'HH:mm:ssXXX"), "Z$", "+00:00")


def utc_z_text(text: Column) -> Column:
    """UTC seconds with Z; null for a time without a zone."""
    t = F.trim(text)
    return F.when(F.rlike(t, F.lit(ZONE)), F.date_format(utc_timestamp(t), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def version_date(explicit: Column, received_at: Column) -> Column:
    """The explicit date if it is an ISO date, else the first ten characters of received_at."""
    t = F.trim(explicit)
    good = F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(t, "yyyy-MM-dd").isNotNull()
    return F.when(good, t).otherwise(F.left(received_at, F.lit(10)))


def ordered_within(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows with place, their number within the key in this order: the ordered lists of one document, artifact, field or pointer."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def latest_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in this order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_scores(scores: DataFrame) -> DataFrame:
    """The last score of each (asset_class, manager_id) of scores(asset_class, manager_id, ord, score), at the place of its first."""
    return scores.groupBy("asset_class", "manager_id").agg(F.min("ord").alias("first_ord"), F.max_by("score", "ord").alias("score"))


def pointer_issues(corrections: DataFrame, documents: DataFrame) -> DataFrame:
    """(event_id, issue) of corrections(event_id, pointer) whose pointer is not documents.{known id}.{field}."""
    parts = F.split("pointer", r"\.")
    formed = F.startswith("pointer", F.lit("documents.")) & (F.size(parts) == 3)
    known = documents.select(F.col("document_id").cast("string").alias("_id")).distinct()
    named = corrections.withColumns({"formed": F.coalesce(formed, F.lit(False)), "_id": F.get(parts, F.lit(1)), "field": F.get(parts, F.lit(2))})
    joined = named.join(known.withColumn("there", F.lit(True)), "_id", "left")
    issue = F.when(~F.col("formed"), "invalid-pointer-format").when(F.col("there").isNull(), "unknown-document").when(~F.col("field").isin(*POINTER_FIELDS), "unknown-field")
    return joined.select("event_id", issue.alias("issue")).where("issue is not null")


def delimited_term(text: Column, term: str) -> Column:
    """Whether a term stands in lower-case text between other letters and digits, its parts apart by spaces, _ or -."""
    parts = [re.sub(r"([^a-z0-9])", r"\\\1", p) for p in re.split(r"[\s_-]+", term.strip()) if p]
    return F.rlike(text, F.lit(r"(?<![a-z0-9])" + r"[\s_-]+".join(parts) + r"(?![a-z0-9])")) if parts else F.lit(False)


def library_type(text: Column, library: dict[str, str]) -> Column:
    """The type of the first library id, in order, that stands in the text, without its prefix stub_ too; null if none does."""
    low = F.lower(text)
    return F.coalesce(*[F.when(delimited_term(low, i) | delimited_term(low, i.removeprefix("stub_")), kind) for i, kind in library.items()])


def coverage_number(value: Column) -> Column:
    """The number of a value that is nothing else: with a sign of money before and %, k, m or b after it; null for other values."""
    pattern = r"(?i)^\s*[$€£]?\s*([+-]?(?:\d+(?:,\d{3})*|\d*)(?:\.\d+)?)\s*([%kmb])?\s*$"
    number = F.replace(F.regexp_extract(value, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    suffix = F.lower(F.regexp_extract(value, pattern, 2))
    return number * F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)


def feedback_issues(feedback: DataFrame) -> DataFrame:
    """(ord, issue) of feedback(ord, artifact_id, reviewer, timestamp, is_informative, quality_rank) that breaks its contract."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = (
        (blank("artifact_id"), "artifact_id"),
        (blank("reviewer"), "reviewer"),
        (blank("timestamp"), "timestamp_required"),
        (~blank("timestamp") & utc_z_text(F.col("timestamp")).isNull(), "timestamp"),
        (F.col("is_informative").isNull(), "is_informative"),
        (~F.coalesce(F.col("quality_rank").between(1, 5), F.lit(False)), "quality_rank"),
    )
    return feedback.select("ord", F.explode(F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))).alias("issue"))
