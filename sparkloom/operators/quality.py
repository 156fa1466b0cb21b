"""Extraction quality: threshold decisions, cross-checks, field accuracy, F1, calibration and confidence buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.strings import magnitude, relative_difference_percent, zero_safe_ratio
from sparkloom.operators.shares import SHARE, dealt

# Thresholds, and by document type the key fields, mandatory fields and least coverage.
THRESHOLDS = {"auto_accept": 0.85, "key_field": 0.75, "coverage": 0.80, "mandatory": 0.60}
PROFILES = {
    "pitchbook": (("terms.management_fee", "performance.net_return_1y", "operations.aum"), ("terms.management_fee", "performance.net_return_1y", "operations.aum"), 0.80),
    "tear_sheet": (("performance.net_return_1y", "operations.aum"), ("operations.aum",), 1.0),
    "monthly_letter": (("performance.net_return_1y", "commentary.market_update"), ("performance.net_return_1y",), 0.5),
    "ddq": (("terms.management_fee", "operations.aum", "operations.inception_date"), ("terms.management_fee", "operations.aum"), 0.80),
}
#: The profile of documents whose type has none.
BASE_PROFILE = (("terms.management_fee", "performance.net_return_1y", "operations.aum"), ("terms.management_fee", "performance.net_return_1y", "operations.aum"), 0.80)
BUCKETS = ((0.0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.0))


def profile_table(spark: SparkSession) -> DataFrame:
    rows = [(k, list(keys), list(need), least) for k, (keys, need, least) in PROFILES.items()]
    return spark.createDataFrame(rows, "doc_type string, key_fields array<string>, mandatory array<string>, least_coverage double")


def best_fields(fields: DataFrame) -> DataFrame:
    """One row for each (document_id, key): the most confident, the earliest of equals; with how many there were."""
    w = Window.partitionBy("document_id", "key")
    first = F.row_number().over(w.orderBy(F.col("confidence").desc(), "ord"))
    return fields.withColumns({"_first": first, "copies": F.count("*").over(w)}).where("_first = 1").drop("_first")


def threshold_decisions(fields: DataFrame, documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Coverage, auto-pass and escalation reason by document.

    fields(document_id, key, confidence, ord), documents(document_id, doc_type). Mandatory fields
    that are missing or unsure come first in the reason, in the profile's order, then repeated
    keys by name; low coverage alone is the last reason. A type without a profile has the base one.
    """
    best = best_fields(fields)
    found = best.groupBy("document_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "confidence"))).alias("confidence"),
        F.array_sort(F.collect_list(F.when(F.col("copies") > 1, F.col("key")))).alias("repeated"),
        F.count_if(F.col("confidence") >= THRESHOLDS["auto_accept"]).alias("auto_accepted"),
    )
    keys, need, least = BASE_PROFILE
    base = {"key_fields": F.array(*[F.lit(k) for k in keys]), "mandatory": F.array(*[F.lit(k) for k in need]), "least_coverage": F.lit(least)}
    rows = documents.join(F.broadcast(profiles), "doc_type", "left").withColumns({k: F.coalesce(k, v) for k, v in base.items()})
    rows = rows.join(found, "document_id", "left")
    sure = F.coalesce("confidence", F.create_map().cast("map<string,double>"))
    value = lambda k: F.try_element_at(sure, k)
    covered = F.size(F.filter("key_fields", lambda k: F.coalesce(value(k) >= THRESHOLDS["key_field"], F.lit(False))))
    failing = F.array_compact(
        F.transform(
            "mandatory",
            lambda k: F.when(value(k).isNull(), F.concat(F.lit("missing_mandatory_field:"), k)).when(value(k) < THRESHOLDS["mandatory"], F.concat(F.lit("confidence_below_threshold:"), k)),
        )
    )
    repeated = F.transform(F.coalesce("repeated", F.array().cast("array<string>")), lambda k: F.concat(F.lit("duplicate_field_key:"), k))
    out = rows.withColumns({"coverage": covered / F.size("key_fields"), "reasons": F.concat(failing, repeated)})
    low = F.col("coverage") < F.col("least_coverage")
    reason = F.when(F.size("reasons") > 0, F.array_join("reasons", ";")).when(low, "low_key_field_coverage")
    return out.select("document_id", "doc_type", "coverage", F.coalesce("auto_accepted", F.lit(0)).cast("bigint").alias("auto_accepted"), reason.isNull().alias("auto_pass"), reason.alias("reason"))


def cross_check(observations: DataFrame, tolerance_percent: float = 5.0) -> DataFrame:
    """Disagreement of several observations of one key: (entity, key, source, value, confidence, ord).

    The accepted one is the largest by confidence, source and value. Whether any two disagree is
    decided by the least and largest value, as the relative difference grows with the distance of
    values of one sign; mixed signs always disagree. Values that do not parse escalate.
    """
    parsed = observations.withColumn("number", magnitude(F.col("value")))
    grouped = parsed.groupBy("entity", "key").agg(
        F.count("*").alias("n"),
        F.max(F.struct("confidence", "source", "value")).alias("accepted"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("number").isNull(), F.col("source")))), ",").alias("unparsed"),
    )
    apart = F.coalesce(relative_difference_percent(F.col("low"), F.col("high")), F.lit(0.0))
    out = grouped.where("n > 1").withColumn("difference_percent", apart)
    reason = F.when(F.col("unparsed") != "", F.concat(F.lit("unparseable:"), F.col("key"), F.lit(":"), F.col("unparsed"))).when(F.col("difference_percent") > tolerance_percent, F.concat(F.lit("disagreement:"), F.col("key")))
    return out.select("entity", "key", "n", F.col("accepted.source").alias("accepted_source"), F.col("accepted.value").alias("accepted_value"), "difference_percent", reason.isNotNull().alias("escalate"), reason.alias("reason"))


def first_disagreements(observations: DataFrame, tolerance_percent: float = 5.0, blocks: int = 256, share: int = SHARE) -> DataFrame:
    """The first pair of each (entity, key) that disagrees, as a nested loop in input order finds it, without any pairs.

    observations(entity, key, ord, source, value): of all pairs i < j by ord whose numbers differ by
    more than the tolerance, the least i, and with it the least j. As the difference grows with the
    distance (and numbers of unlike sign always differ), some later number is outside i's band when
    the least or the largest of the later ones is. Keys are dealt whole to tasks of about ``share``
    rows, read and sorted once, however large the table. For a key with more rows than that, these
    extremes come from windows over blocks of equal width in ord, and from the blocks' own extremes,
    so that it is dealt to several tasks. Then one more pass finds j. Equal ords stand by source and
    value; values without a number take no part; a key of one observation or none that disagree has
    no row.
    """
    if not 0 <= tolerance_percent <= 100:
        raise ValueError("the tolerance must be between 0 and 100")
    keys = ["entity", "key"]
    tasks, large = dealt(observations, keys, share)
    at = F.struct(F.col("ord").cast("bigint").alias("ord"), "source", "value").alias("at")
    number = magnitude(F.col("value")).alias("number")
    small = observations if large is None else observations.join(F.broadcast(large), keys, "left_anti")
    # keys in one column: the plan would put a constant in the place of one, and deal the rows anew
    rows = small.dropna(subset=keys).select(F.struct(*keys).alias("both"), at, number).where("number is not null").repartition(tasks, "both")
    later = Window.partitionBy("both").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({"least": F.min("number").over(later), "most": F.max("number").over(later)})
    found = _second(rows, own.where(_apart("least", tolerance_percent) | _apart("most", tolerance_percent)), ["both"], tolerance_percent).select("both.*", "left", "right")
    if large is not None:
        rows = observations.join(F.broadcast(large), keys, "left_semi").select(*keys, at, number).where("number is not null")
        found = found.union(_second(rows, _left_in_blocks(rows, keys, tolerance_percent, blocks), keys, tolerance_percent))
    difference = relative_difference_percent(F.col("left.number"), F.col("right.number"))
    reason = F.format_string("cross_check_disagreement:%s:%s!=%s:%.4f%%>%.4f%%", "key", "left.at.source", "right.at.source", difference, F.lit(float(tolerance_percent)))
    return found.select(*keys, F.col("left.at.source").alias("left_source"), F.col("left.at.value").alias("left_value"), F.col("right.at.source").alias("right_source"), F.col("right.at.value").alias("right_value"), difference.alias("difference_percent"), reason.alias("reason"))


def _apart(other: str | Column, tolerance_percent: float) -> Column:
    other = F.col(other) if isinstance(other, str) else other
    return F.coalesce(relative_difference_percent(F.col("number"), other) > tolerance_percent, F.lit(False))


def _left_in_blocks(rows: DataFrame, keys: list[str], tolerance_percent: float, blocks: int) -> DataFrame:
    """Rows that disagree with a later one, found block by block."""
    span = rows.groupBy(*keys).agg(F.min("at.ord").alias("low"), F.max("at.ord").alias("high"), F.min("number").alias("least"), F.max("number").alias("most"))
    wide = span.where(relative_difference_percent(F.col("least"), F.col("most")) > tolerance_percent)
    block = F.floor((F.col("at.ord") - F.col("low")) / (F.col("high") - F.col("low") + 1.0) * blocks)
    placed = rows.join(F.broadcast(wide.select(*keys, "low", "high")), keys).select(*keys, "at", "number", block.alias("block"))
    after = Window.partitionBy(*keys).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    extremes = placed.groupBy(*keys, "block").agg(F.min("number").alias("least"), F.max("number").alias("most"))
    extremes = extremes.select(*keys, "block", F.min("least").over(after).alias("least"), F.max("most").over(after).alias("most"))
    later = Window.partitionBy(*keys, "block").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({"own_least": F.min("number").over(later), "own_most": F.max("number").over(later)})
    both = own.join(extremes, [*keys, "block"])
    return both.where(_apart(F.least("own_least", "least"), tolerance_percent) | _apart(F.greatest("own_most", "most"), tolerance_percent))


def _second(rows: DataFrame, left: DataFrame, keys: list[str], tolerance_percent: float) -> DataFrame:
    """The first of the rows that disagree by key, and the first that disagrees with it."""
    left = left.groupBy(*keys).agg(F.min(F.struct("at", "number")).alias("left"))
    right = rows.join(left, keys).where((F.col("at") > F.col("left.at")) & _apart(F.col("left.number"), tolerance_percent))
    return right.groupBy(*keys, "left").agg(F.min(F.struct("at", "number")).alias("right"))


def field_outcomes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer join on (document_id, key): matched, mismatched, missing, unexpected; a repeated actual key mismatches.

    A null value is a value: two nulls match, and it is there on its side. Of a repeated expected key the least value counts.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    one = actual.groupBy("document_id", "key").agg(F.min("value").alias("actual"), F.count("*").alias("copies"))
    wanted = expected.groupBy("document_id", "key").agg(F.min("value").alias("expected")).withColumn("_wanted", F.lit(True))
    both = wanted.join(one, ["document_id", "key"], "full_outer")
    outcome = (
        F.when(F.col("_wanted").isNull(), "unexpected")
        .when(F.col("copies").isNull(), "missing")
        .when((F.col("copies") == 1) & plain(F.col("expected")).eqNullSafe(plain(F.col("actual"))), "matched")
        .otherwise("mismatched")
    )
    return both.withColumn("outcome", outcome).drop("_wanted")


def extraction_f1(outcomes: DataFrame, by: str = "key") -> DataFrame:
    """Precision, recall and F1 by key; 0 where undefined."""
    n = {k: F.count_if(F.col("outcome") == k) for k in ("matched", "mismatched", "missing", "unexpected")}
    counts = outcomes.groupBy(by).agg(*[c.alias(k) for k, c in n.items()])
    m = F.col("matched")
    precision = zero_safe_ratio(m, m + F.col("mismatched") + F.col("unexpected"), 6)
    recall = zero_safe_ratio(m, m + F.col("mismatched") + F.col("missing"), 6)
    f1 = zero_safe_ratio(2 * m, 2 * m + 2 * F.col("mismatched") + F.col("unexpected") + F.col("missing"), 6)
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1})


def calibration_report(rows: DataFrame, by: str) -> DataFrame:
    """rows(confidence, correct or null if unknown): precision overall and of the auto-accepted, and recall over those correct."""
    known, right, auto = F.col("correct").isNotNull(), F.col("correct"), F.col("confidence") >= THRESHOLDS["auto_accept"]
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(known).alias("known"), F.count_if(right).alias("right"), F.count_if(auto & known).alias("auto_n"), F.count_if(auto & right).alias("auto_right"))
    return out.withColumns(
        {
            "precision": zero_safe_ratio(F.col("right"), F.col("known")),
            "auto_precision": zero_safe_ratio(F.col("auto_right"), F.col("auto_n")),
            "auto_recall": zero_safe_ratio(F.col("auto_right"), F.col("right")),
        }
    ).withColumn("suggestion", F.when(F.col("auto_n") == 0, "hold").when(F.col("auto_precision") < 0.8, "raise").when(F.col("auto_precision") > 0.97, "consider_lowering").otherwise("hold"))


def bucket(confidence: Column) -> Column:
    """The half-open bucket of a confidence; the last is closed; null outside."""
    label = F.lit(None).cast("string")
    for k, (a, b) in reversed(list(enumerate(BUCKETS))):
        inside = (confidence >= a) & ((confidence <= b) if k == len(BUCKETS) - 1 else (confidence < b))
        label = F.when(inside, f"{a:.2f}-{b:.2f}").otherwise(label)
    return label


def confidence_buckets(rows: DataFrame) -> DataFrame:
    """Mean confidence, accuracy and their gap in each bucket that has rows of known outcome."""
    known = rows.where("correct is not null").withColumn("bucket", bucket(F.col("confidence"))).where("bucket is not null")
    out = known.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return out.select("bucket", "n", F.round("mean", 4).alias("mean_confidence"), F.round("accuracy", 4).alias("accuracy"), F.round(F.col("mean") - F.col("accuracy"), 4).alias("gap"))
