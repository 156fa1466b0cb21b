"""Exports and reports: return rows, lineage strings, manifests, image items, feedback tables, reviews, log records, intake of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.dates import period_end

FREQUENCIES = ("monthly", "quarterly", "annual")
# Pictures that can be exported, and the weights of a review.
MEDIA_TYPES = ("image/bmp", "image/gif", "image/jpeg", "image/png", "image/svg+xml", "image/tiff")
SKIP_REASONS = ("unsupported_colorspace", "unsupported_encoding")
REVIEW_WEIGHTS = {"usability": 0.5, "adversarial": 0.3, "owner_calibration": 0.2}


def bounded_text(text: Column, most: int) -> Column:
    """The text, or its first most - 1 characters without spaces at the end and an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(max(0, most - 1)))), F.lit("…")))


def display_label(key: Column) -> Column:
    """A key as a label: words with capitals, parts set off by a slash."""
    words = F.replace(F.replace(key, F.lit("_"), F.lit(" ")), F.lit("."), F.lit(" / "))
    return F.when(key == "identity.manager", "Manager").otherwise(F.initcap(words))


def one_pager(profiles: DataFrame, most_fields: int, most_characters: int) -> DataFrame:
    """The fields of profiles(packet_id, fields map) by key, the manager first, at most so many, with labels and bounded values."""
    first = F.transform(F.map_entries("fields"), lambda x: F.struct((x["key"] != "identity.manager").alias("later"), x["key"].alias("key"), x["value"].alias("value")))
    kept = F.slice(F.array_sort(first), 1, most_fields)
    each = profiles.select("packet_id", F.posexplode(kept).alias("place", "x"))
    return each.select("packet_id", "place", display_label(F.col("x.key")).alias("label"), bounded_text(F.col("x.value"), most_characters).alias("value"))


def frequency(text: Column) -> Column:
    """monthly, quarterly or annual in any case and with spaces around; null for all else."""
    x = F.lower(F.trim(text))
    return F.when(x.isin(*FREQUENCIES), x)


def series_rows(rows: DataFrame, source: str) -> DataFrame:
    """rows(series_id, ord, frequency, as_of, value, texts) as points with an issue, which begins with the source; null if the row is good.

    A series without a good monthly row has one more row, with ord null and that issue.
    """
    f, day, value = frequency(F.col("frequency")), F.try_to_date("as_of", "yyyy-MM-dd"), F.col("value").try_cast("double")
    exact = F.rlike("as_of", F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    issue = F.when(f.isNull(), "frequency").when(~F.coalesce(exact, F.lit(False)) | day.isNull(), "as_of").when(value.isNull() | F.isnan(value), "value")
    at = F.concat(F.lit(f"{source}: rows["), F.col("ord").cast("string"), F.lit("]."), issue)
    points = rows.select("series_id", "ord", f.alias("frequency"), F.when(exact, day).alias("as_of"), value.alias("value"), at.alias("issue"))
    lacking = points.groupBy("series_id").agg(F.count_if((F.col("frequency") == "monthly") & F.col("issue").isNull()).alias("n")).where("n = 0")
    none = lambda t: F.lit(None).cast(t)
    return points.union(lacking.select("series_id", none("bigint"), none("string"), none("date"), none("double"), F.lit(f"{source}: monthly data is required")))


def return_rows(points: DataFrame) -> DataFrame:
    """(series_id, period, value, frequency, provenance, place) of points with document_id, page, method: monthly, then quarterly, then annual."""
    order = F.array_position(F.array(*[F.lit(x) for x in FREQUENCIES]), F.col("frequency"))
    provenance = F.concat_ws(":", F.col("document_id").cast("string"), F.coalesce(F.col("page").cast("string"), F.lit("unknown")), "method")
    own = points.select("series_id", F.date_format(period_end(F.col("as_of"), F.col("frequency")), "yyyy-MM-dd").alias("period"), "value", "frequency", provenance.alias("provenance"), order.alias("_order"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy("_order", "period", "provenance", "value"))).drop("_order")


def table_lineage(tables: DataFrame) -> DataFrame:
    """A line for each cell of tables(document_id, page, table_id, index, cells array<struct<row, col, value>>)."""
    name = F.coalesce(F.nullif("table_id", F.lit("")), F.col("index").cast("string"))
    head = F.concat_ws(":", F.coalesce(F.col("document_id").cast("string"), F.lit("unknown")), F.coalesce(F.col("page").cast("string"), F.lit("unknown")), F.lit("table"), name)
    each = tables.select("document_id", head.alias("head"), F.explode("cells").alias("c"))
    return each.select("document_id", F.concat(F.col("head"), F.lit(":r"), F.col("c.row").cast("string"), F.lit(":c"), F.col("c.col").cast("string"), F.lit("="), F.col("c.value")).alias("line"))


def image_items(artifacts: DataFrame) -> DataFrame:
    """Export items of artifacts(document_id, index, path, mime_type, unsupported_reason): a name, or the reason to skip it."""
    ref = F.concat_ws(":image:", F.col("document_id").cast("string"), F.col("index").cast("string"))
    reason = F.col("unsupported_reason")
    skip = F.when(reason.isin(*SKIP_REASONS), reason).when(reason.isNotNull() | ~F.coalesce(F.col("mime_type").isin(*MEDIA_TYPES), F.lit(False)), "unsupported_encoding")
    return artifacts.select("document_id", ref.alias("item_ref"), F.when(skip.isNull(), F.substring_index("path", "/", -1)).alias("name"), F.when(skip.isNull(), F.col("mime_type")).alias("media_type"), skip.alias("skip_reason"))


def manifests(items: DataFrame) -> DataFrame:
    """By document the exported and the skipped references, each sorted, and whether a reference repeats."""
    refs = lambda own: F.array_join(F.array_sort(F.collect_list(F.when(own, F.col("item_ref")))), ",")
    return items.groupBy("document_id").agg(
        refs(F.col("skip_reason").isNull()).alias("artifacts"), refs(F.col("skip_reason").isNotNull()).alias("skipped"), (F.count_distinct("item_ref") < F.count("*")).alias("duplicates")
    )


def feedback_table(summary: DataFrame) -> DataFrame:
    """The rows of a feedback summary as text for a CSV file."""
    ranks = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.col(f"rank_{k}").cast("string")) for k in range(1, 6)]), F.lit("}"))
    flag = F.when(F.col("disagreement"), "true").otherwise("false")
    return summary.select("artifact_id", F.format_string("%.4f", "informative_rate").alias("informative_rate"), F.format_string("%.2f", F.col("mean_rank")).alias("average_quality_rank"), ranks.alias("quality_rank_distribution"), flag.alias("disagreement"))


def reviews(scores: DataFrame, findings: DataFrame, severe: tuple[str, ...], pass_threshold: float, due_after: int) -> DataFrame:
    """The outcome of scores(review_id, usability, adversarial, owner_calibration, completed) with findings(review_id, category, severity).

    The score is weighed; a finding of severity 4 in a category of ``severe`` fails the review.
    """
    worst = findings.where((F.col("severity") == 4) & F.col("category").isin(*severe)).groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("severity_4"))
    total = sum((F.col(k) * w for k, w in REVIEW_WEIGHTS.items()), F.lit(0.0))
    out = scores.join(worst, "review_id", "left").withColumns({"overall": F.round(total, 4), "severity_4": F.coalesce("severity_4", F.lit(""))})
    return out.select("review_id", "overall", ((F.col("overall") >= pass_threshold) & (F.col("severity_4") == "")).alias("passes"), "severity_4", (F.col("completed") >= due_after).alias("review_due"))


def log_records(rows: DataFrame) -> DataFrame:
    """rows(fields map, context map) as one map as text by key; the context wins."""
    kept = F.map_filter("fields", lambda k, _: ~F.array_contains(F.map_keys("context"), k))
    both = F.map_concat(kept, F.col("context"))
    return rows.withColumn("record", F.array_join(F.transform(F.array_sort(F.map_entries(both)), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")).drop("fields", "context")


def document_types(files: DataFrame) -> DataFrame:
    """The distinct file endings of each package, sorted; files without one are left out."""
    ending = F.lower(F.regexp_extract("file_name", r"\.([^./]+)$", 1))
    return files.groupBy("package_id").agg(F.array_join(F.array_sort(F.collect_set(F.nullif(ending, F.lit("")))), ",").alias("document_types"))


def gate_scoring(series: DataFrame) -> DataFrame:
    """series(series_id, tag, confirmed, notes array, names array) with whether an operator must confirm, whether scoring is blocked, and the evidence."""
    needs = (F.col("tag") != "standard") & ~F.coalesce("confirmed", F.lit(False))
    evidence = F.filter(F.transform(F.concat("notes", "names"), lambda x: F.trim(x)), lambda x: x != "")
    return series.select("series_id", needs.alias("needs_confirmation"), F.when(needs, "blocked").otherwise("allowed").alias("gate"), F.array_join(evidence, ";").alias("evidence"))
