"""Queries over packets and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import packets, workflow
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_ELEMENTS = [("ddq", "fee", "numeric_field_present", True), ("ddq", "name", "field_present", True), ("ddq", "note", "field_present", False), ("deck", "fee", "numeric_field_present", True), ("deck", "size", "numeric_field_present", False)]
_VALUES_SQL = "elements(doc_type, key, detector, mandatory) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in _ELEMENTS) + ")"


@query(f"""WITH {_VALUES_SQL}, d AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ddq' ELSE 'deck' END AS doc_type FROM orders),
f AS (SELECT l_orderkey AS document_id, CASE l_partkey % 4 WHEN 0 THEN 'fee' WHEN 1 THEN 'name' WHEN 2 THEN 'note' ELSE 'size' END AS key, CASE WHEN l_suppkey % 5 = 0 THEN 'n/a' WHEN l_suppkey % 5 = 1 THEN ' ' ELSE l_suppkey || '.5m' END AS value, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord FROM lineitem),
one AS (SELECT document_id, key, arg_min(value, ord) AS value FROM f GROUP BY 1, 2),
j AS (SELECT document_id, doc_type, key, mandatory, coalesce(CASE detector WHEN 'field_present' THEN trim(value) <> '' ELSE regexp_matches(value, '[0-9]') END, false) AS det FROM d JOIN elements USING (doc_type) LEFT JOIN one USING (document_id, key))
SELECT document_id, doc_type, count(*) AS elements, count(*) FILTER (det) AS detected, coalesce(string_agg(key, ',' ORDER BY key) FILTER (mandatory AND NOT det), '') AS missing_mandatory FROM j GROUP BY 1, 2""")
def element_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = spark.createDataFrame(_ELEMENTS, "doc_type string, key string, detector string, mandatory boolean")
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 2 == 0, "ddq").otherwise("deck").alias("doc_type"))
    key = F.element_at(F.array(*[F.lit(k) for k in ("fee", "name", "note", "size")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    supplier = F.col("l_suppkey")
    value = F.when(supplier % 5 == 0, "n/a").when(supplier % 5 == 1, " ").otherwise(F.concat(supplier.cast("string"), F.lit(".5m")))
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), key.alias("key"), value.alias("value"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + supplier).alias("ord"))
    return packets.element_coverage(elements, documents, fields)


_TASKS_SQL = "tasks AS (SELECT o_orderkey AS task_id, o_orderkey // 100 AS milestone, [o_orderkey - 1 - o_orderkey % 3, o_orderkey + o_orderkey % 200 - 150] AS depends FROM orders)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    depends = F.array(key - 1 - key % 3, key + key % 200 - 150)
    return table(spark, sf_dir, "orders").select(key.alias("task_id"), F.expr("o_orderkey div 100").alias("milestone"), depends.alias("depends"))


@query(f"""WITH {_TASKS_SQL}, e AS (SELECT task_id, milestone, unnest(depends) AS depends_on FROM tasks)
SELECT e.task_id, depends_on, CASE WHEN t.milestone IS NULL THEN 'missing' ELSE 'later_milestone' END AS issue FROM e LEFT JOIN tasks t ON t.task_id = depends_on WHERE t.milestone IS NULL OR t.milestone > e.milestone""")
def dependency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.dependency_issues(_tasks(spark, sf_dir))


@query(f"""WITH {_TASKS_SQL}, done AS (SELECT o_orderkey AS task_id FROM orders WHERE o_orderkey < 250 OR o_orderkey % 5 > 0), o AS (SELECT * FROM tasks ANTI JOIN done USING (task_id)), b AS (SELECT DISTINCT task_id FROM (SELECT task_id, unnest(depends) AS d FROM o) ANTI JOIN done ON done.task_id = d)
SELECT task_id, milestone, depends FROM o ANTI JOIN b USING (task_id) WHERE milestone = (SELECT min(milestone) FROM o)""")
def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    done = table(spark, sf_dir, "orders").where((key < 250) | (key % 5 > 0)).select(key.alias("task_id"))
    return packets.ready_tasks(_tasks(spark, sf_dir), done)


@query("""WITH c AS (SELECT l_partkey AS document_id, l_suppkey AS package_id, l_shipdate AS tm FROM lineitem), o AS (SELECT document_id, arg_min(package_id, {'a': tm, 'b': package_id}) AS owner FROM c GROUP BY 1 HAVING count(DISTINCT package_id) > 1)
SELECT DISTINCT document_id, package_id, owner FROM c JOIN o USING (document_id) WHERE package_id <> owner""")
def ownership_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.ownership_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("document_id"), F.col("l_suppkey").alias("package_id"), F.col("l_shipdate").alias("at")))


@query("""WITH d AS (SELECT user_id AS batch_id, event_type AS stage, round(value * 100, 2) AS ms FROM events), s AS (SELECT batch_id, coalesce(sum(ms) FILTER (stage = 'view'), 0) AS view, coalesce(sum(ms) FILTER (stage = 'click'), 0) AS click, coalesce(sum(ms) FILTER (stage = 'error'), 0) AS error FROM d GROUP BY 1),
t AS (SELECT *, (view + click + error) / 1000 AS total FROM s)
SELECT batch_id, round(view, 2) AS view, round(click, 2) AS click, round(error, 2) AS error, round(total, 4) AS total_seconds, round(coalesce(28800 / nullif(total, 0), 0), 4) AS daily_capacity,
  concat_ws(',', CASE WHEN view = 0 THEN 'missing:view' WHEN view > 60000 THEN 'slow:view' END, CASE WHEN click = 0 THEN 'missing:click' WHEN click > 60000 THEN 'slow:click' END, CASE WHEN error = 0 THEN 'missing:error' WHEN error > 60000 THEN 'slow:error' END) AS warnings FROM t""")
def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    durations = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("event_type").alias("stage"), F.round(F.col("value") * 100, 2).alias("ms"))
    out = packets.readiness(durations, ["view", "click", "error"], 60_000)
    return out.withColumns({c: F.round(c, 2) for c in ("view", "click", "error")} | {c: F.round(c, 4) for c in ("total_seconds", "daily_capacity")})


@query("""SELECT * FROM (SELECT user_id AS item_id, (event_id % 10) * 1000000000 + event_id AS ord, ts AS happened, lag(ts) OVER (PARTITION BY user_id ORDER BY (event_id % 10) * 1000000000 + event_id) AS before FROM events) WHERE happened < before""")
def audit_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), (F.col("event_id") % 10 * 1_000_000_000 + F.col("event_id")).alias("ord"), F.col("ts").alias("at"))
    return packets.audit_violations(events).withColumnRenamed("at", "happened")


@query("""WITH t AS (SELECT p_partkey AS document_id, 'Page 1 ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' page ' || p_size ELSE '' END || ' target ' || p_type || ' page 99' AS content FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, p_name || ' target' FROM part WHERE p_partkey % 4 = 0)
SELECT document_id, coalesce(CAST(list_extract(regexp_extract_all(left(content, CAST(instr(content, 'target') AS INTEGER) - 1), '(?i)\\bpage\\s+([0-9]+)', 1), -1) AS INTEGER), 0) AS page FROM t""")
def page_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    number = F.when(key % 3 == 0, F.concat(F.lit(" page "), F.col("p_size").cast("string"))).otherwise("")
    content = F.when(key % 4 > 0, F.concat(F.lit("Page 1 "), F.col("p_name"), number, F.lit(" target "), F.col("p_type"), F.lit(" page 99"))).otherwise(F.concat(F.col("p_name"), F.lit(" target")))
    rows = table(spark, sf_dir, "part").select(key.alias("document_id"), content.alias("content"))
    return rows.select("document_id", packets.page_of(F.col("content"), F.instr("content", "target")).alias("page"))


@query("""WITH a AS (SELECT s_suppkey, unnest(list_distinct([s_name, upper(s_name) || ' LLC', 'Zeta, Inc.', 'Alpha  Fund'])) AS name FROM supplier), n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(name)), '\\s+', ' ', 'g'), '([\\s,]*\\b(llc|l\\.l\\.c|lp|l\\.p|ltd|inc)\\.?)+[\\s,]*$', ''), '[\\s,]+$', '')) AS norm FROM a)
SELECT s_suppkey, string_agg(norm || '=' || name, ';' ORDER BY norm, name) AS aliases FROM n GROUP BY 1""")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(F.col("s_name"), F.concat(F.upper("s_name"), F.lit(" LLC")), F.lit("Zeta, Inc."), F.col("s_name"))
    merged = packets.merged_aliases(known, F.lit(" Alpha  Fund "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(merged, lambda x: F.concat_ws("=", x["normalized"], x["name"])), ";").alias("aliases"))


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN '1,' || (100 + o_orderkey % 900) || '.500' WHEN 3 THEN (o_orderkey % 50) || '.00 %' WHEN 4 THEN '  Net   OF Fees ' ELSE CAST(o_orderkey * 100 AS VARCHAR) END AS raw FROM orders),
t AS (SELECT *, lower(regexp_replace(trim(raw), '\\s+', ' ', 'g')) AS x FROM v), p AS (SELECT *, coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%m/%d/%Y')) AS day, regexp_replace(replace(x, ',', ''), '\\s*%$', '') AS plain FROM t)
SELECT o_orderkey, raw, CASE WHEN day IS NOT NULL THEN strftime(day, '%Y-%m-%d') WHEN regexp_matches(plain, '^-?[0-9]+(\\.[0-9]+)?$') THEN regexp_replace(regexp_replace(plain, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || CASE WHEN x LIKE '%\\%' ESCAPE '\\' THEN '%' ELSE '' END ELSE x END AS canonical FROM p""")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    raw = (
        F.when(key % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 6 == 1, F.date_format(day, "M/d/yyyy"))
        .when(key % 6 == 2, F.concat(F.lit("1,"), (100 + key % 900).cast("string"), F.lit(".500")))
        .when(key % 6 == 3, F.concat((key % 50).cast("string"), F.lit(".00 %")))
        .when(key % 6 == 4, "  Net   OF Fees ")
        .otherwise((key * 100).cast("string"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("canonical", packets.canonical_value(F.col("raw")))


@query("""SELECT page_id, 'va_' || left(sha1(page_id || '|p' || (page_id % 7) || '|' || url || '|' || sha256(html)), 16) AS artifact_id FROM pages WHERE url IS NOT NULL AND html IS NOT NULL""")
def artifact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    made = packets.artifact_id(page.cast("string"), F.concat(F.lit("p"), (page % 7).cast("string")), F.col("url"), F.sha2(F.col("html").cast("binary"), 256))
    return table(spark, sf_dir, "pages").where("url is not null and html is not null").select("page_id", made.alias("artifact_id"))


@query("""WITH b AS (SELECT c_custkey AS document_id, 'text.block.' || i AS key, CASE i WHEN 0 THEN c_name ELSE c_mktsegment END AS value, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 + i END AS page, CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM customer, (VALUES (0), (1)) v(i)),
c AS (SELECT c_custkey, 'table.0.r' || (c_custkey % 4) || '.c2', CAST(c_nationkey AS VARCHAR), 3, 0.5::DOUBLE FROM customer) SELECT document_id, key, value, CAST(page AS INTEGER) AS page, confidence FROM b UNION ALL SELECT * FROM c""")
def flat_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    page = lambda n: F.when(key % 3 != 0, n).alias("page")
    blocks = F.array(F.struct(F.col("c_name").alias("text"), page(1), F.lit(0.9).alias("confidence")), F.struct(F.col("c_mktsegment").alias("text"), page(2), F.lit(None).cast("double").alias("confidence")))
    cell = F.struct(F.lit(0).alias("table"), (key % 4).cast("int").alias("row"), F.lit(2).alias("col"), F.col("c_nationkey").cast("string").alias("text"), F.lit(3).alias("page"), F.lit(0.5).alias("confidence"))
    return packets.flat_modalities(table(spark, sf_dir, "customer").select(key.alias("document_id"), blocks.alias("blocks"), F.array(cell).alias("cells")))


@query("""WITH a AS (SELECT l_orderkey AS document_id, l_linenumber AS attempt, 'p' || (l_suppkey % 3) AS provider, l_partkey % 3 = 0 AS ok, 'v' || l_partkey AS value FROM lineitem), u AS (SELECT DISTINCT ON (document_id, attempt) * FROM a ORDER BY document_id, attempt, provider, value),
g AS (SELECT document_id, arg_min(provider, attempt) FILTER (ok AND attempt <= 2) AS provider, arg_min(value, attempt) FILTER (ok AND attempt <= 2) AS value, count(*) FILTER (ok AND attempt <= 2) AS worked, count(DISTINCT provider) FILTER (NOT ok AND attempt <= 2) AS failed_providers, min(attempt) AS first FROM u GROUP BY 1 HAVING min(attempt) <= 2)
SELECT document_id, provider, value, failed_providers, CASE WHEN worked > 0 THEN 'none' WHEN failed_providers > 1 THEN 'ops_review' ELSE 'analyst_review' END AS route FROM g""")
def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("attempt"),
        F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string")).alias("provider"),
        (F.col("l_partkey") % 3 == 0).alias("ok"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("value"),
    )
    one = attempts.groupBy("document_id", "attempt").agg(F.min(F.struct("provider", "value", "ok")).alias("x")).select("document_id", "attempt", "x.*")
    return packets.provider_route(one)


@query("""WITH r AS (SELECT source, doc_id % 3 > 0 AS predicted, quality = 1 AS actual FROM documents JOIN labels USING (doc_id)), n AS (SELECT source, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM r GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS accuracy FROM n""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("actual"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id").select("source", (F.col("doc_id") % 3 > 0).alias("predicted"), "actual")
    return packets.confusion(rows, "source")


@query("""SELECT o_orderpriority AS agent, o_orderstatus AS tier, round(sum(o_totalprice), 2) AS cost, count(*) FILTER (o_orderkey % 4 = 0) AS successes, count(*) AS records, round(sum(o_totalprice) / nullif(count(*) FILTER (o_orderkey % 4 = 0), 0), 2) AS cost_per_success FROM orders GROUP BY 1, 2""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("agent"), F.col("o_orderstatus").alias("tier"), F.col("o_totalprice").alias("cost"), (F.col("o_orderkey") % 4 == 0).alias("verified"))
    return packets.cost_per_success(rows, "agent", "tier").withColumns({c: F.round(c, 2) for c in ("cost", "cost_per_success")})


_QUEUE_ALLOWED = ", ".join(f"'{a}>{b}'" for a, bs in workflow.QUEUE_MOVES.items() for b in bs)
_QUEUE_STATE = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(workflow.NEXT_ACTION)) + " END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id * 10 + event_id % 7 AS item_id, {_QUEUE_STATE} AS to_state, row_number() OVER (PARTITION BY user_id * 10 + event_id % 7 ORDER BY ts, event_id) AS n FROM events),
f(item_id, n, state, moves, illegal) AS (SELECT DISTINCT item_id, CAST(0 AS BIGINT), '', 0, 0 FROM e UNION ALL
  SELECT f.item_id, e.n, CASE WHEN f.state || '>' || e.to_state IN ({_QUEUE_ALLOWED}) THEN e.to_state ELSE f.state END,
    f.moves + CASE WHEN f.state || '>' || e.to_state IN ({_QUEUE_ALLOWED}) AND f.state <> e.to_state THEN 1 ELSE 0 END,
    f.illegal + CASE WHEN f.state || '>' || e.to_state NOT IN ({_QUEUE_ALLOWED}) AND f.state <> e.to_state THEN 1 ELSE 0 END FROM f JOIN e ON e.item_id = f.item_id AND e.n = f.n + 1)
SELECT item_id, arg_max(state, n) AS state, arg_max(moves, n) AS moves, arg_max(illegal, n) AS illegal FROM f GROUP BY 1""")
def queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    to = F.element_at(F.array(*[F.lit(s) for s in workflow.NEXT_ACTION]), (key % 6 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 10 + key % 7).alias("item_id"), F.col("ts").alias("at"), key.alias("ord"), to.alias("to_state"))
    return workflow.lifecycle(events, workflow.QUEUE_MOVES)
