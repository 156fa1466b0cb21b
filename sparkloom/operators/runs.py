"""Runs and packets: projections of fields, summaries of decisions, checklists, validity issues, drift and stage records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import quality, workflow

SUMMARY_PREFIX = "confidence.document."
# What a fleet record must hold.
SCHEMA_VERSION, STATUSES = "langsmith-fleet/v1", ("error", "fallback", "no_secret", "skipped", "success")
SENSITIVE_TOKENS = (
    "payload", "document_text", "document_content", "document_body", "raw_document", "raw_text", "extracted_value", "extracted_text",
    "prompt", "completion", "model_output", "secret", "api_key", "ssn", "account_number", "pii",
)
OPERATIONS = ("package-intake", "document-extraction", "validation-escalation", "scoring-summary")
QUIET_ESCALATIONS = ("none", "accepted")


def _text(items: Column) -> Column:
    return F.array_join(items, ";")


def merged_profiles(profiles: DataFrame, base: dict[str, object]) -> DataFrame:
    """Profiles with what they leave null taken from base; a mandatory list that is there counts even if it is empty."""
    literal = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list | tuple) else F.lit(v)
    return profiles.withColumns({k: F.coalesce(k, literal(v)) for k, v in base.items()})


def threshold_value(text: Column) -> Column:
    """A threshold from 0 to 1; null if the text is no number or outside."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & x.between(0.0, 1.0), x)


def first_fields(fields: DataFrame, prefix: str) -> DataFrame:
    """The first value of each key with the prefix, over the documents of a package in order (doc_ord, field_ord)."""
    own = fields.where(F.startswith("key", F.lit(prefix)))
    return own.groupBy("package_id", "key").agg(F.min_by("value", F.struct("doc_ord", "field_ord")).alias("value"))


def lineage_refs(fields: DataFrame) -> DataFrame:
    """fields with ref, doc:key:pN:method."""
    return fields.withColumn("ref", F.concat_ws(":", "document_id", "key", F.concat(F.lit("p"), F.col("page").cast("string")), "method"))


def run_fields(fields: DataFrame) -> DataFrame:
    """Fields as JSON records; a location or snippet that is null is left out."""
    return fields.select("document_id", F.to_json(F.struct("key", "value", "confidence", F.col("document_id").cast("string").alias("source_doc_id"), "source_page", "method", "location", "snippet_metadata")).alias("record"))


def run_metadata(packages: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of packages(package_id, document_ids) as a JSON array in order; one that is unknown has its id only."""
    each = packages.select("package_id", F.posexplode("document_ids").alias("pos", "document_id")).join(documents, "document_id", "left")
    facts = F.struct(F.col("document_id").cast("string").alias("document_id"), *[c for c in documents.columns if c != "document_id"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.to_json(facts).alias("json"))))
    return each.groupBy("package_id").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["json"]), ","), F.lit("]")).alias("documents"))


def summary_fields(decisions: DataFrame) -> DataFrame:
    """Three rows (document_id, key, value, confidence, page, method) for each of decisions(document_id, coverage, auto_pass, reason)."""
    each = F.array(
        *[
            F.struct(F.lit(SUMMARY_PREFIX + k).alias("key"), v.alias("value"))
            for k, v in (
                ("key_field_coverage_ratio", F.format_string("%.4f", F.col("coverage"))),
                ("auto_pass", F.when(F.col("auto_pass"), "true").otherwise("false")),
                ("escalation_reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit("none"))),
            )
        ]
    )
    return decisions.select("document_id", F.inline(each)).withColumns({"confidence": F.lit(1.0), "page": F.lit(0), "method": F.lit("threshold-summary")})


def with_summary(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """fields and after them the summary fields, as a bag."""
    return fields.unionByName(summary_fields(decisions))


def threshold_summary(fields: DataFrame) -> DataFrame:
    """The summary fields of each document as key=value, by key."""
    own = fields.where(F.startswith("key", F.lit(SUMMARY_PREFIX)))
    return own.groupBy("document_id").agg(_text(F.array_sort(F.collect_list(F.concat_ws("=", "key", "value")))).alias("document"))


def run_warnings(packages: DataFrame) -> DataFrame:
    """Sorted warnings of packages(package_id, codes array, escalate, reason)."""
    codes = F.transform(F.coalesce("codes", F.array().cast("array<string>")), lambda c: F.concat(F.lit("intake:"), c))
    reason = F.when(F.col("escalate") & (F.col("reason") != ""), F.array(F.concat(F.lit("threshold:"), "reason"))).otherwise(F.array().cast("array<string>"))
    return packages.select("package_id", _text(F.array_sort(F.concat(codes, reason))).alias("warnings"))


def escalation_reports(decisions: DataFrame) -> DataFrame:
    """Whether any of decisions(entity, key, escalate, reason) of an entity escalates, and the reasons by key."""
    reasons = F.array_sort(F.collect_list(F.when(F.col("escalate"), F.struct("key", "reason"))))
    return decisions.groupBy("entity").agg(F.count("*").alias("decisions"), F.bool_or("escalate").alias("escalate"), _text(F.transform(reasons, lambda x: x["reason"])).alias("reasons"))


def mean_confidence(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """The mean confidence of each document's fields, 0 without any."""
    means = fields.groupBy("document_id").agg(F.avg("confidence").alias("mean"))
    return documents.join(means, "document_id", "left").select("document_id", F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("extraction_confidence"))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """Detected of all elements, and the document types, by package of coverage(package_id, doc_type, elements, detected)."""
    return coverage.groupBy("package_id").agg(F.sum("detected").alias("detected"), F.sum("elements").alias("total"), _text(F.array_sort(F.collect_set("doc_type"))).alias("doc_types"))


def root_latency(spans: DataFrame, root: str) -> DataFrame:
    """Whole milliseconds of each run's root span in spans(run_id, name, started_at, ended_at), 0 at least; open spans have none."""
    micros = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    own = spans.where((F.col("name") == root) & F.col("ended_at").isNotNull())
    return own.groupBy("run_id").agg(F.greatest(F.lit(0), F.floor(F.min_by(micros, F.col("started_at")) / 1000)).cast("bigint").alias("latency_ms"))


def deviation_candidates(fields: DataFrame) -> DataFrame:
    """Fields that may describe a clause that is not standard."""
    return fields.where(F.startswith("key", F.lit("ppm.deviation.")) | F.contains(F.lower("value"), F.lit("non-standard")))


def checklist(elements: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Each element (key, mandatory) for each document: present with the citation of its first field, missing, or not observed."""
    first = fields.groupBy("document_id", "key").agg(F.min(F.struct("ord", "page")).alias("first"))
    rows = documents.crossJoin(F.broadcast(elements)).join(first, ["document_id", "key"], "left")
    status = F.when(F.col("first").isNotNull(), "present").when(F.col("mandatory"), "missing").otherwise("not observed")
    citation = F.concat_ws(":", F.col("document_id").cast("string"), "key", F.concat(F.lit("p"), F.col("first.page").cast("string")))
    return rows.select("document_id", "key", "mandatory", status.alias("status"), F.when(F.col("first").isNotNull(), citation).otherwise("").alias("citation"))


def result_issues(fields: DataFrame) -> DataFrame:
    """(document_id, key, issue) of fields(document_id, key, source_doc_id, method, confidence, char_start, char_end) that break the result contract."""
    rules = (
        (~F.col("source_doc_id").eqNullSafe(F.col("document_id")), "source_doc_id"),
        (F.coalesce("method", F.lit("")) == "", "method"),
        (~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence"),
        ((F.col("char_start") < 0) | (F.col("char_end") < F.col("char_start")), "snippet"),
    )
    return fields.select("document_id", "key", F.explode(F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))).alias("issue"))


def safe_artifact_ref(ref: Column) -> Column:
    """Whether a reference is artifact: and a relative path that stays below its root."""
    path = F.substring(ref, 10, 1 << 30)
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    odd = F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")) | (F.trim(path) != path) | F.endswith(F.get(parts, F.lit(0)), F.lit(":")) | F.array_contains(parts, "..")
    return F.coalesce(F.startswith(ref, F.lit("artifact:")) & (F.size(parts) > 0) & ~odd, F.lit(False))


def fleet_issues(records: DataFrame) -> DataFrame:
    """(record_id, issue) of records(record_id, schema_version, status, domain map, artifact_ref, artifact_refs array) that break the record contract."""
    rules = (
        (F.col("schema_version").isNull() | F.col("status").isNull() | F.col("domain").isNull(), "missing_field"),
        (F.col("schema_version") != SCHEMA_VERSION, "schema_version"),
        (~F.col("status").isin(*STATUSES), "status"),
        (F.col("artifact_ref").isNotNull() & ~safe_artifact_ref(F.col("artifact_ref")), "artifact_ref"),
        (F.exists("artifact_refs", lambda x: ~safe_artifact_ref(x)), "artifact_refs"),
        (F.exists(F.map_keys("domain"), lambda k: F.rlike(F.lower(k), F.lit("|".join(SENSITIVE_TOKENS)))), "sensitive_payload"),
    )
    return records.select("record_id", F.explode(F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))).alias("issue"))


def stage_records(runs: DataFrame) -> DataFrame:
    """Four records for each of runs(run_id, base_status, validation_status, retry_count, escalation_state): (run_id, operation, status)."""
    failed = F.col("validation_status") == "error"
    extraction = F.when(failed, "error").when((F.col("retry_count") > 0) | ~F.col("escalation_state").isin(*QUIET_ESCALATIONS), "fallback").otherwise(F.col("base_status"))
    status = (F.col("base_status"), extraction, F.when(failed, "error").otherwise(F.col("base_status")), F.col("base_status"))
    return runs.select("run_id", F.inline(F.array(*[F.struct(F.lit(o).alias("operation"), s.alias("status")) for o, s in zip(OPERATIONS, status, strict=True)])))


def escalation_counts(runs: DataFrame) -> DataFrame:
    """How many of three sources escalate: the decision, the cross-check and the lifecycle."""
    return runs.select("run_id", reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("threshold_escalates", "cross_check_escalates", "lifecycle_escalates")]).alias("escalations"))


def trace_drift(samples: DataFrame, events: DataFrame, least_f1: float) -> DataFrame:
    """How far sampled traces are from samples(document_id, key, value): one row of counts, F1, drift = 1 - F1 and status.

    Of events(ord, document_id, ended_at, fields array of (key, value)) the first that has ended counts for each sampled document.
    """
    ids = samples.select("document_id").distinct()
    first = events.where("ended_at is not null and fields is not null").join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.min_by("fields", "ord").alias("fields"))
    actual = first.select("document_id", F.inline("fields"))
    counts = quality.field_outcomes(samples, actual).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("matched", "mismatched", "missing", "unexpected")])
    seen = events.agg(F.count("*").alias("trace_events")).crossJoin(first.agg(F.count("*").alias("matched_traces")))  # one row each
    f1 = F.round(F.coalesce(F.try_divide(2.0 * F.col("matched"), 2.0 * F.col("matched") + 2.0 * F.col("mismatched") + F.col("missing") + F.col("unexpected")), F.lit(0.0)), 6)
    out = counts.crossJoin(seen).withColumn("f1", f1)
    return out.withColumns({"drift": F.round(1 - F.col("f1"), 6), "status": F.when(F.col("f1") >= least_f1, "pass").otherwise("drift")})


def feedback_totals(feedback: DataFrame) -> DataFrame:
    """One row over the latest feedback of all artifacts."""
    latest = workflow.latest_feedback(feedback)
    whole = latest.agg(F.count("*").alias("records"), F.count_distinct("artifact_id").alias("artifacts"), F.count_distinct("reviewer").alias("reviewers"), F.count_if("is_informative").alias("informative"), F.round(F.avg("quality_rank"), 4).alias("mean_rank"))
    each = workflow.feedback_summary(feedback).agg(F.count_if(F.col("reviews") > 1).alias("several_reviewers"), F.count_if("disagreement").alias("disagreements"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 4)
    return whole.crossJoin(each).withColumns({"informative_rate": ratio("informative", "records"), "disagreement_rate": ratio("disagreements", "several_reviewers")})


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of some tables."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in tables.items()])


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether two tables have the same distinct keys, and how many are on one side only."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    out = both.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
    return out.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))
