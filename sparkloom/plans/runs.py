"""Queries over runs and packets; orders stand for packages or runs, line items for fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import quality, runs, workflow
from sparkloom.plans.quality import _OBS_SQL, observations
from sparkloom.plans.registry import query
from sparkloom.plans.workflow import _FEEDBACK_SQL, feedback
from sparkloom.sources.tables import table

_KEYS = ("identity.manager", "terms.management_fee", "terms.lockup", "performance.net_return_1y", "ppm.deviation.side_letter", "operations.aum")
_KEY_SQL = "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KEYS)) + " END"
FIELDS_SQL = f"""fields AS (SELECT l_orderkey // 4 AS package_id, l_orderkey AS document_id, l_orderkey AS doc_ord, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey AS field_ord, {_KEY_SQL} AS key,
  CASE WHEN l_suppkey % 9 = 0 THEN 'a Non-Standard clause' ELSE 'v' || l_suppkey END AS value, (l_suppkey % 101) / 100.0::DOUBLE AS confidence, l_linenumber AS page, CASE WHEN l_suppkey % 2 = 0 THEN 'pdf-primary' ELSE 'primary-regex' END AS method FROM lineitem)"""


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 4").alias("package_id"),
        order.alias("document_id"),
        order.alias("doc_ord"),
        (F.col("l_linenumber").cast("bigint") * 100_000_000 + part * 1000 + supplier).alias("field_ord"),
        _pick(_KEYS, part % 6).alias("key"),
        F.when(supplier % 9 == 0, "a Non-Standard clause").otherwise(F.concat(F.lit("v"), supplier.cast("string"))).alias("value"),
        (supplier % 101 / F.lit(100.0)).alias("confidence"),
        F.col("l_linenumber").alias("page"),
        F.when(supplier % 2 == 0, "pdf-primary").otherwise("primary-regex").alias("method"),
    )


@query("""SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 0.9 ELSE 0.85 END::DOUBLE AS field_auto_accept_min, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS document_key_field_coverage_min,
  CASE n_nationkey % 4 WHEN 0 THEN 'operations.aum' WHEN 1 THEN '' ELSE 'terms.management_fee;performance.net_return_1y;operations.aum' END AS mandatory_fields FROM nation""")
def threshold_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    mandatory = F.when(key % 4 == 0, F.array(F.lit("operations.aum"))).when(key % 4 == 1, F.array().cast("array<string>"))
    own = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(key % 3 == 0, 0.9).alias("field_auto_accept_min"), F.when(key % 2 == 0, 1.0).alias("document_key_field_coverage_min"), mandatory.alias("mandatory_fields"))
    base = {"field_auto_accept_min": 0.85, "document_key_field_coverage_min": 0.8, "mandatory_fields": ["terms.management_fee", "performance.net_return_1y", "operations.aum"]}
    return runs.merged_profiles(own, base).withColumn("mandatory_fields", F.array_join("mandatory_fields", ";"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0.' || json_extract_string(props, '$.k') WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN event_type WHEN 3 THEN CAST(value AS VARCHAR) ELSE '-0.' || user_id END AS raw FROM events), x AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS d FROM t)
SELECT event_id, CASE WHEN d BETWEEN 0 AND 1 THEN d END AS value FROM x""")
def threshold_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds written as an event's own numbers and names."""
    k = F.get_json_object("props", "$.k")
    forms = (F.concat(F.lit("0."), k), k, F.col("event_type"), F.col("value").cast("string"), F.concat(F.lit("-0."), F.col("user_id").cast("string")))
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", runs.threshold_value(raw).alias("value"))


@query(f"WITH {FIELDS_SQL} SELECT package_id, key, arg_min(value, (doc_ord, field_ord)) AS value FROM fields WHERE starts_with(key, 'terms.') GROUP BY 1, 2")
def packet_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.first_fields(fields(spark, sf_dir), "terms.")


@query(f"WITH {FIELDS_SQL} SELECT document_id, field_ord, document_id || ':' || key || ':p' || page || ':' || method AS ref FROM fields")
def lineage_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.lineage_refs(fields(spark, sf_dir)).select("document_id", "field_ord", "ref")


@query(f"""WITH {FIELDS_SQL} SELECT document_id, '{{"key":"' || key || '","value":"' || value || '","confidence":' || confidence || ',"source_doc_id":"' || document_id || '","source_page":' || page || ',"method":"' || method || '"' ||
  CASE WHEN page > 2 THEN ',"location":{{"source_page":' || page || ',"table_index":1}}' ELSE '' END || CASE WHEN page % 2 = 0 THEN ',"snippet_metadata":{{"kind":"regex-match","char_start":' || page || ',"char_end":' || (page + 5) || '}}' ELSE '' END || '}}' AS record FROM fields""")
def run_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page")
    location = F.when(page > 2, F.struct(page.alias("source_page"), F.lit(1).alias("table_index"), F.lit(None).cast("array<double>").alias("bbox")))
    snippet = F.when(page % 2 == 0, F.struct(F.lit("regex-match").alias("kind"), page.alias("char_start"), (page + 5).alias("char_end")))
    return runs.run_fields(fields(spark, sf_dir).withColumns({"source_page": page, "location": location, "snippet_metadata": snippet}))


@query("""WITH p AS (SELECT o_custkey AS package_id, list(CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1), e AS (SELECT package_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM p)
SELECT package_id, '[' || string_agg('{"document_id":"' || id || '"' || CASE WHEN o_orderkey IS NULL THEN '' ELSE ',"file_name":"' || o_orderpriority || '.pdf","source_channel":"email"' END || '}', ',' ORDER BY pos) || ']' AS documents FROM e LEFT JOIN orders ON o_orderkey = id GROUP BY 1""")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ids = F.transform(F.array_sort(F.collect_list(key)), lambda k: F.when(k % 7 == 0, -k).otherwise(k))
    documents = orders.select(key.alias("document_id"), F.concat("o_orderpriority", F.lit(".pdf")).alias("file_name"), F.lit("email").alias("source_channel"))
    return runs.run_metadata(orders.groupBy(F.col("o_custkey").alias("package_id")).agg(ids.alias("document_ids")), documents)


_DECISIONS_SQL = "decisions AS (SELECT o_orderkey AS document_id, (o_orderkey % 5) / 4.0::DOUBLE AS coverage, o_orderkey % 5 > 2 AS auto_pass, CASE WHEN o_orderkey % 5 <= 2 THEN 'low_key_field_coverage' END AS reason FROM orders)"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("document_id"), (key % 5 / F.lit(4.0)).alias("coverage"), (key % 5 > 2).alias("auto_pass"), F.when(key % 5 <= 2, "low_key_field_coverage").alias("reason"))


_SUMMARY_SQL = f"""{_DECISIONS_SQL}, summary AS (SELECT document_id, 'confidence.document.key_field_coverage_ratio' AS key, printf('%.4f', coverage) AS value FROM decisions UNION ALL SELECT document_id, 'confidence.document.auto_pass', CASE WHEN auto_pass THEN 'true' ELSE 'false' END FROM decisions
  UNION ALL SELECT document_id, 'confidence.document.escalation_reason', coalesce(reason, 'none') FROM decisions)"""


@query(f"WITH {FIELDS_SQL}, {_SUMMARY_SQL} SELECT document_id, key, value, confidence, page, method FROM fields UNION ALL SELECT document_id, key, value, 1.0::DOUBLE, 0, 'threshold-summary' FROM summary")
def fields_with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_summary(fields(spark, sf_dir).select("document_id", "key", "value", "confidence", "page", "method"), _decisions(spark, sf_dir))


@query(f"WITH {_SUMMARY_SQL} SELECT document_id, string_agg(key || '=' || value, ';' ORDER BY key) AS document FROM summary GROUP BY 1")
def threshold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = runs.with_summary(fields(spark, sf_dir).select("document_id", "key", "value", "confidence", "page", "method"), _decisions(spark, sf_dir))
    return runs.threshold_summary(both)


@query("""WITH p AS (SELECT o_orderkey AS package_id, CASE o_orderkey % 3 WHEN 0 THEN ['missing_source_ref'] WHEN 1 THEN ['late', 'missing_source_ref'] END AS codes, o_orderkey % 2 = 0 AS escalate, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'low_key_field_coverage' END AS reason FROM orders)
SELECT package_id, array_to_string(list_sort(list_concat(list_transform(coalesce(codes, []), lambda x: 'intake:' || x), CASE WHEN escalate AND reason <> '' THEN ['threshold:' || reason] ELSE [] END)), ';') AS warnings FROM p""")
def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    codes = F.when(key % 3 == 0, F.array(F.lit("missing_source_ref"))).when(key % 3 == 1, F.array(F.lit("late"), F.lit("missing_source_ref")))
    return runs.run_warnings(table(spark, sf_dir, "orders").select(key.alias("package_id"), codes.alias("codes"), (key % 2 == 0).alias("escalate"), F.when(key % 4 == 0, "").otherwise("low_key_field_coverage").alias("reason")))


_CHECKED_SQL = f"""{_OBS_SQL}, p AS (SELECT entity % 20 AS entity, key || '.' || entity AS key, source, value, CASE WHEN value = 'n/a' THEN NULL ELSE CAST(regexp_extract(value, '[0-9]+') AS DOUBLE) * 1e6 END AS number FROM obs),
g AS (SELECT entity, key, min(number) AS low, max(number) AS high, coalesce(string_agg(DISTINCT CASE WHEN number IS NULL THEN source END, ',' ORDER BY CASE WHEN number IS NULL THEN source END), '') AS unparsed FROM p GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT entity, key, CASE WHEN unparsed <> '' THEN 'unparseable:' || key || ':' || unparsed WHEN coalesce(abs(low - high) / greatest(abs(low), abs(high), 1e-12) * 100, 0) > 5 THEN 'disagreement:' || key END AS reason FROM g)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return quality.cross_check(rows.select((F.col("entity") % 20).alias("entity"), F.concat_ws(".", "key", F.col("entity").cast("string")).alias("key"), "source", "value", "confidence"))


@query(f"WITH {_CHECKED_SQL} SELECT entity, count(*) AS decisions, bool_or(reason IS NOT NULL) AS escalate, coalesce(string_agg(reason, ';' ORDER BY key, reason), '') AS reasons FROM r GROUP BY 1")
def cross_check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.escalation_reports(_checked(spark, sf_dir))


@query(f"WITH {_CHECKED_SQL} SELECT entity || ':validation:extraction_cross_check' AS item_id, CAST(entity AS VARCHAR) AS package_id, 'pending_triage' AS state, string_agg(reason, ';' ORDER BY key, reason) AS escalation_reason FROM r WHERE reason IS NOT NULL GROUP BY entity")
def cross_check_queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.cross_check_items(runs.escalation_reports(_checked(spark, sf_dir)))


@query(f"WITH {FIELDS_SQL}, f AS (SELECT * FROM fields WHERE document_id % 3 > 0) SELECT o_orderkey AS document_id, round(coalesce(avg(confidence), 0), 6) AS extraction_confidence FROM orders LEFT JOIN f ON document_id = o_orderkey GROUP BY 1")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fields(spark, sf_dir).withColumn("document_id", F.when(F.col("document_id") % 3 > 0, F.col("document_id")))
    return runs.mean_confidence(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")), own)


@query("""WITH c AS (SELECT o_custkey AS package_id, o_orderstatus AS doc_type, o_orderkey % 6 AS elements, o_orderkey % 3 AS detected FROM orders)
SELECT package_id, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(elements) AS BIGINT) AS total, string_agg(DISTINCT doc_type, ';' ORDER BY doc_type) AS doc_types FROM c GROUP BY 1""")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return runs.coverage_totals(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package_id"), F.col("o_orderstatus").alias("doc_type"), (key % 6).alias("elements"), (key % 3).alias("detected")))


@query("""WITH s AS (SELECT user_id AS run_id, event_type AS name, ts AS a, CASE WHEN event_id % 4 > 0 THEN ts + to_microseconds(CAST(value * 1000 AS BIGINT) - 5000) END AS b FROM events)
SELECT run_id, CAST(greatest(0, floor(arg_min(date_diff('microsecond', a, b), a) / 1000.0)) AS BIGINT) AS latency_ms FROM s WHERE name = 'view' AND b IS NOT NULL GROUP BY 1""")
def root_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("ts + make_dt_interval(0, 0, 0, (cast(round(value * 1000) as bigint) - 5000) / 1000000)")
    spans = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 4 > 0, end).alias("ended_at"))
    return runs.root_latency(spans, "view")


@query(f"WITH {FIELDS_SQL} SELECT document_id, field_ord, key, value FROM fields WHERE starts_with(key, 'ppm.deviation.') OR contains(lower(value), 'non-standard')")
def deviation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.deviation_candidates(fields(spark, sf_dir)).select("document_id", "field_ord", "key", "value")


_CHECKLIST = [("identity.manager", True), ("terms.lockup", False), ("operations.aum", True), ("terms.gates", True)]


@query(f"""WITH {FIELDS_SQL}, e(key, mandatory) AS (VALUES {', '.join(f"('{k}', {str(m).lower()})" for k, m in _CHECKLIST)}), f AS (SELECT document_id, key, arg_min(page, (field_ord, page)) AS page FROM fields GROUP BY 1, 2)
SELECT o_orderkey AS document_id, e.key, mandatory, CASE WHEN page IS NOT NULL THEN 'present' WHEN mandatory THEN 'missing' ELSE 'not observed' END AS status, CASE WHEN page IS NULL THEN '' ELSE o_orderkey || ':' || e.key || ':p' || page END AS citation FROM orders CROSS JOIN e LEFT JOIN f ON f.document_id = o_orderkey AND f.key = e.key""")
def ppm_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    elements = spark.createDataFrame(_CHECKLIST, "key string, mandatory boolean")
    return runs.checklist(elements, documents, fields(spark, sf_dir).withColumn("ord", F.col("field_ord")))


@query(f"""WITH {FIELDS_SQL}, x AS (SELECT document_id, field_ord, key, CASE WHEN field_ord % 11 = 0 THEN document_id + 1 ELSE document_id END AS src, CASE WHEN field_ord % 13 = 0 THEN '' ELSE method END AS method, confidence * 1.02 AS confidence, page AS a, CASE WHEN field_ord % 17 = 0 THEN page - 1 ELSE page + 3 END AS b FROM fields)
SELECT document_id, key, 'source_doc_id' AS issue FROM x WHERE src <> document_id UNION ALL SELECT document_id, key, 'method' FROM x WHERE method = '' UNION ALL SELECT document_id, key, 'confidence' FROM x WHERE confidence > 1 UNION ALL SELECT document_id, key, 'snippet' FROM x WHERE b < a""")
def result_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, page = F.col("field_ord"), F.col("page")
    rows = fields(spark, sf_dir).withColumns(
        {
            "source_doc_id": F.when(at % 11 == 0, F.col("document_id") + 1).otherwise(F.col("document_id")),
            "method": F.when(at % 13 == 0, "").otherwise(F.col("method")),
            "confidence": F.col("confidence") * 1.02,
            "char_start": page,
            "char_end": F.when(at % 17 == 0, page - 1).otherwise(page + 3),
        }
    )
    return runs.result_issues(rows)


_REFS = ("artifact:run.json", "artifact:a/b.json", "artifact:../x", "artifact:/etc/x", "file:run.json", "artifact:c:/x", "artifact:", "artifact:a//b", "artifact: x")
_SAFE = (True, True, False, False, False, False, False, True, False)


@query(f"""WITH r AS (SELECT event_id AS record_id, CASE event_id % 9 {' '.join(f"WHEN {i} THEN {str(x).lower()}" for i, x in enumerate(_SAFE))} END AS safe, event_type FROM events)
SELECT record_id, 'schema_version' AS issue FROM r WHERE record_id % 50 = 0 UNION ALL SELECT record_id, 'status' FROM r WHERE event_type = 'view' UNION ALL SELECT record_id, 'artifact_ref' FROM r WHERE NOT safe
UNION ALL SELECT record_id, 'missing_field' FROM r WHERE record_id % 40 = 0 UNION ALL SELECT record_id, 'artifact_refs' FROM r WHERE record_id % 9 = 4 UNION ALL SELECT record_id, 'sensitive_payload' FROM r WHERE record_id % 30 = 7""")
def fleet_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    domain = F.when(key % 40 != 0, F.create_map(F.when(key % 30 == 7, "Raw_Text").otherwise("package_id"), F.lit("x")))
    ref = _pick(_REFS, key % 9)
    records = table(spark, sf_dir, "events").select(
        key.alias("record_id"),
        F.when(key % 50 == 0, "v0").otherwise(runs.SCHEMA_VERSION).alias("schema_version"),
        F.when(F.col("event_type") == "view", "odd").otherwise("success").alias("status"),
        domain.alias("domain"),
        ref.alias("artifact_ref"),
        F.when(key % 9 == 4, F.array(F.lit("artifact:ok"), ref)).alias("artifact_refs"),
    )
    return runs.fleet_issues(records)


_RUNS_SQL = "r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'success' ELSE 'no_secret' END AS base, CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'accepted' END AS v, o_orderkey % 3 AS retries, CASE o_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'accepted' ELSE 'escalated' END AS e FROM orders)"


@query(f"""WITH {_RUNS_SQL} SELECT run_id, 'package-intake' AS operation, base AS status FROM r UNION ALL SELECT run_id, 'document-extraction', CASE WHEN v = 'error' THEN 'error' WHEN retries > 0 OR e = 'escalated' THEN 'fallback' ELSE base END FROM r
UNION ALL SELECT run_id, 'validation-escalation', CASE WHEN v = 'error' THEN 'error' ELSE base END FROM r UNION ALL SELECT run_id, 'scoring-summary', base FROM r""")
def stage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        F.when(key % 2 == 0, "success").otherwise("no_secret").alias("base_status"),
        F.when(key % 5 == 0, "error").otherwise("accepted").alias("validation_status"),
        (key % 3).alias("retry_count"),
        _pick(("none", "accepted", "escalated", "escalated"), key % 4).alias("escalation_state"),
    )
    return runs.stage_records(rows)


@query("SELECT o_orderkey AS run_id, CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderkey % 3 = 0 AS INTEGER) + CAST(o_orderkey % 5 = 0 AND o_orderkey % 7 > 0 AS INTEGER) AS escalations FROM orders")
def escalation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return runs.escalation_counts(table(spark, sf_dir, "orders").select(key.alias("run_id"), (key % 2 == 0).alias("threshold_escalates"), (key % 3 == 0).alias("cross_check_escalates"), F.when(key % 7 > 0, key % 5 == 0).alias("lifecycle_escalates")))


@query("""WITH s AS (SELECT c_custkey AS document_id, k AS key, 'v' || c_nationkey AS value FROM customer, (VALUES ('a'), ('b')) t(k) WHERE c_custkey % 3 = 0), e AS (SELECT event_id AS ord, user_id AS document_id, event_id % 6 > 0 AS ended FROM events),
f AS (SELECT document_id, min(ord) AS ord FROM e WHERE ended AND document_id IN (SELECT document_id FROM s) GROUP BY 1), a AS (SELECT f.document_id, x.key, x.value FROM f JOIN customer ON c_custkey = f.document_id, (VALUES ('a', 0), ('c', 1)) t(key, z), LATERAL (SELECT t.key, CASE WHEN z = 0 AND f.ord % 2 = 0 THEN 'V' || c_nationkey ELSE 'other' END AS value) x),
o AS (SELECT CASE WHEN s.document_id IS NULL THEN 'unexpected' WHEN a.document_id IS NULL THEN 'missing' WHEN lower(s.value) = lower(a.value) THEN 'matched' ELSE 'mismatched' END AS outcome FROM s FULL JOIN a ON s.document_id = a.document_id AND s.key = a.key),
n AS (SELECT count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'mismatched') AS mismatched, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'unexpected') AS unexpected FROM o),
g AS (SELECT *, (SELECT count(*) FROM e) AS trace_events, (SELECT count(*) FROM f) AS matched_traces, round(coalesce(2.0 * matched / nullif(2 * matched + 2 * mismatched + missing + unexpected, 0), 0)::DOUBLE, 6) AS f1 FROM n)
SELECT *, round(1 - f1, 6) AS drift, CASE WHEN f1 >= 0.95 THEN 'pass' ELSE 'drift' END AS status FROM g""")
def trace_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").cast("string").alias("n"))
    samples = customers.where("document_id % 3 = 0").select("document_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("key"), F.concat(F.lit("v"), "n").alias("value"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("document_id"), F.when(F.col("event_id") % 6 > 0, F.col("ts")).alias("ended_at")).join(customers, "document_id", "left")
    known = F.col("n").isNotNull()
    value = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("V"), "n")).otherwise("other")
    pairs = F.array(F.struct(F.lit("a").alias("key"), value.alias("value")), F.struct(F.lit("c").alias("key"), F.lit("other").alias("value")))
    return runs.trace_drift(samples, events.withColumn("fields", F.when(known, pairs)), 0.95)


@query(f"""WITH {_FEEDBACK_SQL}, a AS (SELECT count(*) AS n, count(*) > 1 AND (bool_and(is_informative) <> bool_or(is_informative) OR max(quality_rank) - min(quality_rank) >= 2) AS dis FROM latest GROUP BY artifact_id),
w AS (SELECT count(*) AS records, count(DISTINCT artifact_id) AS artifacts, count(DISTINCT reviewer) AS reviewers, count(*) FILTER (is_informative) AS informative, round(avg(quality_rank), 4) AS mean_rank FROM latest), x AS (SELECT count(*) FILTER (n > 1) AS several_reviewers, count(*) FILTER (dis) AS disagreements FROM a)
SELECT *, round(coalesce(informative / nullif(records, 0)::DOUBLE, 0), 4) AS informative_rate, round(coalesce(disagreements / nullif(several_reviewers, 0)::DOUBLE, 0), 4) AS disagreement_rate FROM w, x""")
def feedback_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.feedback_totals(feedback(spark, sf_dir))


@query("SELECT 'firms' AS name, count(*) AS rows FROM supplier UNION ALL SELECT 'funds', count(*) FROM part UNION ALL SELECT 'documents', count(*) FROM documents")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.row_counts({"firms": table(spark, sf_dir, "supplier"), "funds": table(spark, sf_dir, "part"), "documents": table(spark, sf_dir, "documents")})


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.repeated_keys(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("""WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem), r AS (SELECT p_partkey AS k FROM part), n AS (SELECT (SELECT count(*) FROM l ANTI JOIN r USING (k)) AS left_only, (SELECT count(*) FROM r ANTI JOIN l USING (k)) AS right_only)
SELECT *, left_only = 0 AND right_only = 0 AS equal FROM n""")
def same_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.same_keys(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k")
