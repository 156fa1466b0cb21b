"""Queries over exports, reports and the tooling kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import exports, tooling, workflow
from sparkloom.plans.registry import query
from sparkloom.plans.workflow import _FEEDBACK_SQL, feedback
from sparkloom.sources.tables import table


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _map(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])


@query("""WITH f AS (SELECT p_partkey AS packet_id, unnest([{'l': 0, 'k': 'identity.manager', 'v': p_name}, {'l': 1, 'k': 'terms.management_fee', 'v': p_type || '    ' || p_brand}, {'l': 1, 'k': 'operations.aum', 'v': p_brand}, {'l': 1, 'k': 'z.last', 'v': 'x'}]) AS x FROM part),
r AS (SELECT packet_id, CAST(row_number() OVER (PARTITION BY packet_id ORDER BY x.l, x.k) - 1 AS INTEGER) AS place, x.k AS k, x.v AS v FROM f)
SELECT packet_id, place, CASE k WHEN 'identity.manager' THEN 'Manager' WHEN 'terms.management_fee' THEN 'Terms / Management Fee' ELSE 'Operations / Aum' END AS label, CASE WHEN length(v) <= 12 THEN v ELSE rtrim(left(v, 11)) || '…' END AS value FROM r WHERE place < 3""")
def one_pager(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _map(("z.last", F.lit("x")), ("terms.management_fee", F.concat("p_type", F.lit("    "), "p_brand")), ("operations.aum", F.col("p_brand")), ("identity.manager", F.col("p_name")))
    return exports.one_pager(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("packet_id"), fields.alias("fields")), 3, 12)


_ROWS_SQL = """r AS (SELECT user_id AS series_id, event_id AS ord, CASE event_id % 5 WHEN 0 THEN ' Monthly' WHEN 1 THEN 'QUARTERLY ' WHEN 2 THEN 'weekly' WHEN 3 THEN 'annual' ELSE NULL END AS frequency, CASE WHEN event_id % 7 = 0 THEN '2024-1-05' ELSE strftime(ts, '%Y-%m-%d') END AS as_of, CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS VARCHAR) || '.5' END AS value FROM events)"""


@query(f"""WITH {_ROWS_SQL}, p AS (SELECT series_id, ord, CASE WHEN event_kind IN ('monthly', 'quarterly', 'annual') THEN event_kind END AS frequency, as_of AS raw, value AS v FROM (SELECT *, lower(trim(frequency)) AS event_kind FROM r)),
x AS (SELECT series_id, ord, frequency, CASE WHEN length(raw) = 10 THEN CAST(raw AS DATE) END AS as_of, TRY_CAST(v AS DOUBLE) AS value, CASE WHEN frequency IS NULL THEN 'xlsx: rows[' || ord || '].frequency' WHEN length(raw) < 10 THEN 'xlsx: rows[' || ord || '].as_of' WHEN v = 'n/a' THEN 'xlsx: rows[' || ord || '].value' END AS issue FROM p)
SELECT * FROM x UNION ALL SELECT series_id, NULL, NULL, NULL, NULL, 'xlsx: monthly data is required' FROM x GROUP BY series_id HAVING count(*) FILTER (frequency = 'monthly' AND issue IS NULL) = 0""")
def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        key.alias("ord"),
        _pick((" Monthly", "QUARTERLY ", "weekly", "annual", None), key % 5).alias("frequency"),
        F.when(key % 7 == 0, "2024-1-05").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("as_of"),
        F.when(key % 11 == 0, "n/a").otherwise(F.concat((key % 100).cast("string"), F.lit(".5"))).alias("value"),
    )
    return exports.series_rows(rows, "xlsx")


@query("""WITH p AS (SELECT o_custkey AS series_id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS value, CASE o_orderkey % 3 WHEN 0 THEN 'annual' WHEN 1 THEN 'monthly' ELSE 'quarterly' END AS frequency, o_orderkey || ':' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR) ELSE 'unknown' END || ':pdf-primary' AS provenance FROM orders),
r AS (SELECT series_id, strftime(CASE frequency WHEN 'monthly' THEN last_day(d) WHEN 'quarterly' THEN last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTHS AS DATE)) ELSE make_date(year(d), 12, 31) END, '%Y-%m-%d') AS period, value, frequency, provenance, CASE frequency WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 2 ELSE 3 END AS o FROM p)
SELECT series_id, period, value, frequency, provenance, CAST(row_number() OVER (PARTITION BY series_id ORDER BY o, period, provenance, value) AS INTEGER) AS place FROM r""")
def return_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("series_id"), F.col("o_orderdate").cast("date").alias("as_of"), F.col("o_totalprice").alias("value"), _pick(("annual", "monthly", "quarterly"), key % 3).alias("frequency"), key.alias("document_id"), F.when(key % 2 == 0, key % 9).alias("page"), F.lit("pdf-primary").alias("method")
    )
    return exports.return_rows(points)


@query("""WITH t AS (SELECT c_custkey AS document_id, c_custkey || ':' || CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE '2' END || ':table:' || CASE WHEN c_custkey % 2 = 0 THEN 't1' ELSE '4' END AS head, c_name, c_mktsegment FROM customer)
SELECT document_id, head || ':r0:c0=' || c_name AS line FROM t UNION ALL SELECT document_id, head || ':r1:c2=' || c_mktsegment FROM t""")
def table_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.col(v).alias("value"))
    rows = table(spark, sf_dir, "customer").select(key.alias("document_id"), F.when(key % 3 > 0, 2).alias("page"), F.when(key % 2 == 0, "t1").otherwise("").alias("table_id"), F.lit(4).alias("index"), F.array(cell(0, 0, "c_name"), cell(1, 2, "c_mktsegment")).alias("cells"))
    return exports.table_lineage(rows)


_ITEMS_SQL = """i AS (SELECT l_orderkey AS document_id, l_orderkey || ':image:' || l_linenumber AS item_ref, 'p' || l_partkey || '.png' AS name, CASE WHEN l_suppkey % 4 = 0 THEN 'image/webp' ELSE 'image/tiff' END AS media_type, l_suppkey % 4 = 0 OR l_partkey % 5 = 0 AS skip, l_partkey % 5 = 0 AND l_partkey % 2 = 0 AS colour FROM lineitem)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("index"),
        F.concat(F.lit("store/x/p"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("path"),
        F.when(F.col("l_suppkey") % 4 == 0, "image/webp").otherwise("image/tiff").alias("mime_type"),
        F.when(F.col("l_partkey") % 10 == 0, "unsupported_colorspace").when(F.col("l_partkey") % 5 == 0, "cmyk").alias("unsupported_reason"),
    )
    return exports.image_items(artifacts)


@query(f"WITH {_ITEMS_SQL} SELECT document_id, item_ref, CASE WHEN NOT skip THEN name END AS name, CASE WHEN NOT skip THEN media_type END AS media_type, CASE WHEN colour THEN 'unsupported_colorspace' WHEN skip THEN 'unsupported_encoding' END AS skip_reason FROM i")
def image_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)


@query(f"WITH {_ITEMS_SQL} SELECT document_id, coalesce(string_agg(item_ref, ',' ORDER BY item_ref) FILTER (NOT skip), '') AS artifacts, coalesce(string_agg(item_ref, ',' ORDER BY item_ref) FILTER (skip), '') AS skipped, count(DISTINCT item_ref) < count(*) AS duplicates FROM i GROUP BY 1")
def export_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.manifests(_items(spark, sf_dir))


@query(f"""WITH {_FEEDBACK_SQL}, s AS (SELECT artifact_id, count(*) AS n, count(*) FILTER (is_informative) AS i, round(avg(quality_rank), 4) AS m, {', '.join(f'count(*) FILTER (quality_rank = {k}) AS r{k}' for k in range(1, 6))}, count(*) > 1 AND (bool_and(is_informative) <> bool_or(is_informative) OR max(quality_rank) - min(quality_rank) >= 2) AS d FROM latest GROUP BY 1)
SELECT artifact_id, printf('%.4f', round(i / n::DOUBLE, 4)) AS informative_rate, printf('%.2f', m) AS average_quality_rank, '{{' || concat_ws(', ', {', '.join(f"'{chr(34)}{k}{chr(34)}: ' || r{k}" for k in range(1, 6))}) || '}}' AS quality_rank_distribution, CASE WHEN d THEN 'true' ELSE 'false' END AS disagreement FROM s""")
def feedback_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.feedback_table(workflow.feedback_summary(feedback(spark, sf_dir)))


@query("""WITH s AS (SELECT c_custkey AS review_id, round((c_custkey % 10) * 0.5::DOUBLE + (c_custkey % 7) * 0.3::DOUBLE + (c_custkey % 4) * 0.2::DOUBLE, 4) AS overall, c_custkey % 6 AS completed FROM customer), f AS (SELECT user_id AS review_id, event_type AS category, event_id % 5 AS severity FROM events),
w AS (SELECT review_id, string_agg(DISTINCT category, ',' ORDER BY category) AS severity_4 FROM f WHERE severity = 4 AND category IN ('error', 'view') GROUP BY 1)
SELECT review_id, overall, overall >= 5 AND severity_4 IS NULL AS passes, coalesce(severity_4, '') AS severity_4, completed >= 3 AS review_due FROM s LEFT JOIN w USING (review_id)""")
def ux_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    scores = table(spark, sf_dir, "customer").select(key.alias("review_id"), (key % 10).alias("usability"), (key % 7).alias("adversarial"), (key % 4).alias("owner_calibration"), (key % 6).alias("completed"))
    findings = table(spark, sf_dir, "events").select(F.col("user_id").alias("review_id"), F.col("event_type").alias("category"), (F.col("event_id") % 5).alias("severity"))
    return exports.reviews(scores, findings, ("error", "view"), 5.0, 3)


@query("SELECT event_id, 'actor=' || event_type || ';level=' || CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'info' END || ';run=' || user_id AS record FROM events")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    fields = _map(("level", F.when(key % 2 == 0, "debug").otherwise("info")), ("actor", F.col("event_type")))
    context = F.when(key % 2 == 0, _map(("level", F.lit("warn")), ("run", F.col("user_id").cast("string")))).otherwise(_map(("run", F.col("user_id").cast("string"))))
    return exports.log_records(table(spark, sf_dir, "events").select("event_id", fields.alias("fields"), context.alias("context")))


@query("""WITH f AS (SELECT o_custkey AS package_id, CASE o_orderkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN NULL ELSE 'txt' END AS e FROM orders) SELECT package_id, coalesce(string_agg(DISTINCT e, ',' ORDER BY e), '') AS document_types FROM f GROUP BY 1""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _pick(("a.b.PDF", "x.xlsx", "notes", "dir.d/t.txt"), F.col("o_orderkey") % 4)
    return exports.document_types(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package_id"), name.alias("file_name")))


@query("""WITH s AS (SELECT p_partkey AS series_id, p_partkey % 3 > 0 AND coalesce(p_partkey % 4 <> 0, true) AS needs, p_name, p_partkey % 2 = 0 AS blank FROM part)
SELECT series_id, needs AS needs_confirmation, CASE WHEN needs THEN 'blocked' ELSE 'allowed' END AS gate, CASE WHEN blank THEN '' ELSE 'note;' END || p_name AS evidence FROM s""")
def scoring_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key.alias("series_id"), F.when(key % 3 == 0, "standard").otherwise("blended").alias("tag"), F.when(key % 4 != 1, key % 4 == 0).alias("confirmed"), F.array(F.when(key % 2 == 0, "  ").otherwise(" note")).alias("notes"), F.array("p_name").alias("names"))
    return exports.gate_scoring(rows)


_RECORD_KEYS = ("type", "workflow", "metric_type", "verdict", "stop_reason", "fix_applied", "escalation_reason", "step_name")


@query(f"""WITH r AS (SELECT event_id, [{', '.join(map(repr, _RECORD_KEYS))}][CAST(user_id % 8 + 1 AS INTEGER)] AS k, CAST(json_extract(props, '$.k') AS INTEGER) AS n, event_type FROM events),
v AS (SELECT *, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN event_type || '-verify' WHEN 2 THEN 'Keepalive ' || event_type ELSE 'step' END AS value FROM r)
SELECT event_id, CASE WHEN k IN ('type', 'workflow', 'metric_type') AND value LIKE 'Keepalive%' THEN 'keepalive' WHEN k IN ('type', 'workflow', 'metric_type') AND value LIKE '%verify' THEN 'verifier' WHEN k IN ('type', 'workflow', 'metric_type') AND value = 'step' THEN 'autopilot'
  WHEN k = 'stop_reason' THEN 'keepalive' WHEN k = 'fix_applied' THEN 'autofix' WHEN k = 'verdict' THEN 'verifier' WHEN k = 'escalation_reason' OR k = 'step_name' AND n % 5 = 0 THEN 'autopilot' ELSE 'unknown' END AS class FROM v""")
def record_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of an event's own columns; a key whose value is null is there, too."""
    n, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    value = F.when(n % 4 == 1, F.concat(kind, F.lit("-verify"))).when(n % 4 == 2, F.concat(F.lit("Keepalive "), kind)).when(n % 4 == 3, "step")
    json = F.concat(F.lit('{"'), _pick(_RECORD_KEYS, F.col("user_id") % 8), F.lit('": '), F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null")), F.when(n % 5 == 0, ', "duration_ms": 4').otherwise(""), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", tooling.record_class(json).alias("class"))


@query("""WITH r AS (SELECT event_type AS kind, user_id % 100 AS pr, CASE WHEN event_id % 3 > 0 THEN event_id % 10 END AS it, CASE event_id % 4 WHEN 0 THEN 'tasks-complete' WHEN 1 THEN '' END AS stop, event_id % 5 AS total, event_id % 3 AS done FROM events)
SELECT kind, count(*) AS runs, count(DISTINCT pr) AS prs, round(coalesce(avg(it), 0), 6) AS avg_iterations, count(*) FILTER (stop = 'tasks-complete' OR (total > 0 AND done >= total)) AS tasks_complete FROM r GROUP BY 1""")
def keepalive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 100).alias("pr_number"), F.when(key % 3 > 0, key % 10).alias("iteration"), F.when(key % 4 == 0, "tasks-complete").when(key % 4 == 1, "").alias("stop_reason"), (key % 5).alias("tasks_total"), (key % 3).alias("tasks_complete"))
    return tooling.keepalive_summary(rows, "kind")


@query("""WITH r AS (SELECT event_type AS kind, CASE event_id % 3 WHEN 0 THEN 'lint' WHEN 1 THEN '' END AS trigger, CASE WHEN event_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS gate FROM events)
SELECT kind, 'trigger' AS counter, trigger AS value, count(*) AS n FROM r WHERE trigger <> '' GROUP BY 1, 3 UNION ALL SELECT kind, 'gate', gate, count(*) FROM r GROUP BY 1, 3""")
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return tooling.counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(key % 3 == 0, "lint").when(key % 3 == 1, "").alias("trigger"), F.when(key % 2 == 0, "pass").otherwise("fail").alias("gate")), "kind", "trigger", "gate")


@query("SELECT event_type AS kind, count(*) AS attempts, count(DISTINCT user_id % 50) AS prs, count(*) FILTER (event_id % 5 < 3) AS fixes_applied FROM events GROUP BY 1")
def autofix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 50).alias("pr_number"), _pick(("true", "True", "1", "false", None), F.col("event_id") % 5).alias("fix_applied"))
    return tooling.autofix_summary(rows, "kind")


@query("SELECT event_type AS step_name, count(*) AS n, round(avg(event_id % 1000), 6) AS mean_ms, count(*) FILTER (event_id % 7 > 0) AS succeeded, count(*) FILTER (event_id % 7 = 0) AS failed FROM events GROUP BY 1")
def step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return tooling.step_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("step_name"), (key % 1000).alias("duration_ms"), (key % 7 > 0).alias("success")))


_CASES_SQL = """c AS (SELECT p_partkey AS run_id, 'tests.' || p_brand || '::a' AS nodeid, p_size / 4.0::DOUBLE AS time, CASE WHEN p_partkey % 3 = 0 THEN 'failure' ELSE 'passed' END AS status FROM part UNION ALL SELECT p_partkey, 'tests.x::b', 0.25, 'skipped' FROM part UNION ALL SELECT p_partkey, 'tests.x::c', 0.25, 'passed' FROM part)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("p_partkey") % 3 == 0, '<failure>no &amp; never</failure>').otherwise("")
    parts = [F.lit('<testsuite><testcase classname="tests.'), F.col("p_brand"), F.lit('" name="a" time="'), (F.col("p_size") / F.lit(4.0)).cast("string"), F.lit('">'), bad, F.lit('</testcase><testcase classname="tests.x" name="b" time="0.25"><skipped>x</skipped></testcase><testcase classname="tests.x" name="c" time="0.25"></testcase></testsuite>')]
    return tooling.test_cases(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.concat(*parts).alias("xml")))


@query(f"WITH {_CASES_SQL} SELECT * FROM c")
def test_report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


@query(f"WITH {_CASES_SQL} SELECT run_id, nodeid, time, status, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY time DESC, nodeid) AS n FROM c) WHERE n <= 2")
def slowest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tooling.slowest(_cases(spark, sf_dir), 2)


@query(f"WITH {_CASES_SQL} SELECT run_id, status, count(*) AS n FROM c GROUP BY 1, 2")
def test_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tooling.status_counts(_cases(spark, sf_dir))


@query("""WITH r AS (SELECT p_partkey AS run_id, (p_partkey % 40) / 4.0::DOUBLE AS current, (p_partkey % 7) / 2.0::DOUBLE AS baseline FROM part), d AS (SELECT *, CASE WHEN baseline > 0 THEN greatest(0, baseline - current) ELSE 0 END AS dr FROM r)
SELECT run_id, round(current - baseline, 4) AS delta, round(dr, 4) AS drop, CASE WHEN baseline <= 0 THEN 'no-baseline' WHEN dr > 0 AND dr >= 1 THEN 'alert' ELSE 'ok' END AS status FROM d""")
def coverage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return tooling.coverage_delta(table(spark, sf_dir, "part").select(key.alias("run_id"), (key % 40 / F.lit(4.0)).alias("current"), (key % 7 / F.lit(2.0)).alias("baseline")), 1.0)


_FILES_SQL = "f AS (SELECT l_orderkey AS run_id, 'p' || l_partkey || '/' || l_suppkey || '/' || l_linenumber AS path, CAST(l_partkey % 101 AS DOUBLE) AS percent, CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 9 ELSE 0 END AS missing, l_partkey % 500 AS total FROM lineitem)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    path = F.concat(F.lit("p"), F.concat_ws("/", *[c.cast("string") for c in (part, supplier, F.col("l_linenumber"))]))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), path.alias("path"), (part % 101).cast("double").alias("percent"), F.when(F.col("l_orderkey") % 2 == 0, supplier % 9).otherwise(0).alias("missing"), (part % 500).alias("total"))


@query(f"WITH {_FILES_SQL} SELECT run_id, path, percent, missing, total, CAST(n AS INTEGER) AS place, percent < 50 AS low FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY percent, path) AS n FROM f) WHERE n <= 3")
def coverage_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tooling.coverage_hotspots(_files(spark, sf_dir), 3, 50.0)


@query(f"""WITH {_FILES_SQL}, l AS (SELECT *, max(missing) OVER (PARTITION BY run_id) > 0 AS lacks FROM f)
SELECT run_id, path, percent, missing, total, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN lacks THEN missing ELSE total END DESC, percent, path) AS n FROM l WHERE NOT lacks OR missing > 0) WHERE n <= 3""")
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tooling.top_files(_files(spark, sf_dir), 3)


@query("""WITH s AS (SELECT c_custkey, c_mktsegment AS workflow, sha256('{"inputs":{"a":"' || c_name || '","b":"1"},"version":"v1","workflow":"' || c_mktsegment || '"}') AS fingerprint FROM customer) SELECT c_custkey, workflow, fingerprint, c_custkey % 2 = 1 AS changed, CASE WHEN c_custkey % 2 = 1 THEN 'no-prior-fingerprint' ELSE 'fingerprint-match' END AS reason FROM s""")
def state_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("workflow"), _map(("b", F.lit("1")), ("a", F.col("c_name"))).alias("inputs"))
    once = tooling.state_fingerprints(rows.withColumn("previous", F.lit(None).cast("string")), "v1")
    kept = once.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("fingerprint")).alias("previous"))
    return tooling.state_fingerprints(rows.join(kept, "c_custkey"), "v1")


@query(r"""WITH l AS (SELECT doc_id AS file, unnest(string_split(coalesce(text, '') || chr(10) || 'ERROR: late' || chr(10) || 'x', chr(10))) AS t, generate_subscripts(string_split(coalesce(text, '') || chr(10) || 'ERROR: late' || chr(10) || 'x', chr(10)), 1) - 1 AS line FROM documents),
m AS (SELECT file, line, 'error' AS sign FROM l WHERE regexp_matches(t, '(?i)\berror\b') UNION ALL SELECT file, line, 'license' FROM l WHERE regexp_matches(t, '(?i)licen[cs]e')) SELECT file, sign, count(*) AS lines, CAST(min(line) AS INTEGER) AS first_line FROM m GROUP BY 1, 2""")
def log_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nERROR: late\nx")).alias("content"))
    return tooling.log_evidence(logs, {"error": r"(?i)\berror\b", "license": r"(?i)licen[cs]e"})


@query("""WITH r AS (SELECT p_brand AS "group", p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT "group", p_partkey FROM r WHERE 12345 % n = k""")
def rotating_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tooling.rotating_sample(table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), "p_partkey"), "p_partkey", F.lit(12345))
