"""Queries over queues, lifecycles and feedback; orders and events stand for items and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import intake, workflow
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_STATES = list(workflow.NEXT_ACTION)
_STATE_SQL = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"
_ACTION_SQL = "CASE state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in workflow.NEXT_ACTION.items()) + " END"


@query(f"""WITH q AS (SELECT o_orderkey AS item_id, o_custkey AS package_id, {_STATE_SQL} AS state, CASE WHEN o_orderkey % 4 > 0 THEN 'u' || (o_custkey % 9) END AS owner_id, o_orderdate AS updated_at FROM orders)
SELECT item_id, package_id, state, owner_id, updated_at, {_ACTION_SQL} AS next_action FROM q WHERE state IN ('pending_triage', 'ops_review') AND updated_at >= TIMESTAMP '1996-01-01'
ORDER BY updated_at DESC, item_id DESC LIMIT 50 OFFSET 20""")
def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (key % 6 + 1).cast("int"))
    owner = F.when(key % 4 > 0, F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string")))
    rows = table(spark, sf_dir, "orders").select(key.alias("item_id"), F.col("o_custkey").alias("package_id"), state.alias("state"), owner.alias("owner_id"), F.col("o_orderdate").alias("updated_at"))
    wanted = F.col("state").isin("pending_triage", "ops_review") & (F.col("updated_at") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return workflow.queue_page(rows, wanted, offset=20).withColumn("next_action", workflow.next_action(F.col("state")))


_EVENT_STATE = "CASE event_id % 4 WHEN 0 THEN 'received' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'escalated' END"
_ALLOWED = ", ".join(f"'{a}>{b}'" for a, bs in workflow.INGEST_MOVES.items() for b in bs)


LIFECYCLE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id * 100 + event_id % 50 AS item_id, {_EVENT_STATE} AS to_state, row_number() OVER (PARTITION BY user_id * 100 + event_id % 50 ORDER BY ts, event_id) AS n FROM events),
f(item_id, n, state, moves, illegal) AS (SELECT DISTINCT item_id, CAST(0 AS BIGINT), '', 0, 0 FROM e UNION ALL
  SELECT f.item_id, e.n, CASE WHEN f.state || '>' || e.to_state IN ({_ALLOWED}) THEN e.to_state ELSE f.state END,
    f.moves + CASE WHEN f.state || '>' || e.to_state IN ({_ALLOWED}) AND f.state <> e.to_state THEN 1 ELSE 0 END,
    f.illegal + CASE WHEN f.state || '>' || e.to_state NOT IN ({_ALLOWED}) AND f.state <> e.to_state THEN 1 ELSE 0 END FROM f JOIN e ON e.item_id = f.item_id AND e.n = f.n + 1)
SELECT item_id, arg_max(state, n) AS state, arg_max(moves, n) AS moves, arg_max(illegal, n) AS illegal FROM f GROUP BY 1"""


@query(LIFECYCLE_SQL)
def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    to = F.element_at(F.array(*[F.lit(s) for s in ("received", "processing", "completed", "escalated")]), (key % 4 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + key % 50).alias("item_id"), F.col("ts").alias("at"), key.alias("ord"), to.alias("to_state"))
    return workflow.lifecycle(events, workflow.INGEST_MOVES)


@query("""WITH b AS (SELECT user_id AS item_id, min(ts) AS created_at FROM events GROUP BY 1), d AS (SELECT *, date_trunc('day', created_at) + INTERVAL '23:59:59' AS due_at FROM b),
l AS (SELECT item_id, min(ts) AS breached_at FROM events JOIN d ON user_id = item_id WHERE ts > due_at GROUP BY 1)
SELECT item_id, created_at, CAST(due_at AS TIMESTAMP) AS due_at, breached_at, breached_at IS NOT NULL AS breached FROM d LEFT JOIN l USING (item_id)""")
def sla_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = workflow.sla_breaches(table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("at")))
    return out.withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id AS span, CASE event_type WHEN 'view' THEN 'start' ELSE 'end' END AS kind, ts AS tm, event_id AS ord FROM events WHERE event_type IN ('view', 'purchase')),
b AS (SELECT *, sum(CASE kind WHEN 'start' THEN 1 ELSE -1 END) OVER (PARTITION BY span ORDER BY tm, ord) AS bal FROM e),
o AS (SELECT *, kind = 'end' AND bal < least(coalesce(min(bal) OVER (PARTITION BY span ORDER BY tm, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS orphan FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY span, kind ORDER BY tm, ord) AS n FROM o WHERE NOT orphan)
SELECT s.span, CAST(s.n AS INTEGER) AS n, s.tm AS started_at, t.tm AS ended_at, epoch_us(t.tm) - epoch_us(s.tm) AS micros FROM n s JOIN n t ON s.span = t.span AND s.n = t.n AND s.kind = 'start' AND t.kind = 'end'""")
def span_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "start").otherwise("end")
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    return workflow.span_durations(events.select(F.col("user_id").alias("span"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("ord")))


@query("""WITH f AS (SELECT c_custkey AS field_id, c_name AS value FROM customer), c AS (SELECT user_id AS field_id, ts AS corrected_at, event_id AS correction_id, event_type || ':' || event_id AS corrected_value FROM events WHERE event_type <> 'view'),
l AS (SELECT field_id, arg_max(corrected_value, {'a': corrected_at, 'b': correction_id}) AS v, count(*) AS n FROM c GROUP BY 1)
SELECT field_id, coalesce(v, value) AS value, v IS NOT NULL AS corrected, coalesce(n, 0) AS corrections FROM f LEFT JOIN l USING (field_id)""")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("field_id"), F.col("c_name").alias("value"))
    events = table(spark, sf_dir, "events").where("event_type <> 'view'")
    value = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return workflow.latest_values(fields, events.select(F.col("user_id").alias("field_id"), F.col("ts").alias("corrected_at"), F.col("event_id").alias("correction_id"), value.alias("corrected_value")))


_FEEDBACK_SQL = """fb AS (SELECT event_type AS artifact_id, 'r' || user_id AS reviewer, event_id % 3 > 0 AS is_informative, CAST(1 + event_id % 5 AS INTEGER) AS quality_rank, ts AS reviewed_at, event_id AS ord FROM events),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, reviewer ORDER BY reviewed_at DESC, ord DESC) AS rn FROM fb) WHERE rn = 1)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("artifact_id"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("reviewer"),
        (key % 3 > 0).alias("is_informative"),
        (1 + key % 5).cast("int").alias("quality_rank"),
        F.col("ts").alias("reviewed_at"),
        key.alias("ord"),
    )


@query(f"WITH {_FEEDBACK_SQL} SELECT * FROM latest")
def feedback_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.latest_feedback(feedback(spark, sf_dir))


@query(f"""WITH {_FEEDBACK_SQL} SELECT artifact_id, count(*) AS reviews, count(*) FILTER (is_informative) AS informative, round(avg(quality_rank), 4) AS mean_rank,
  {', '.join(f'count(*) FILTER (quality_rank = {k}) AS rank_{k}' for k in range(1, 6))}, min(reviewed_at) AS first_at, max(reviewed_at) AS last_at,
  round(count(*) FILTER (is_informative) / count(*)::DOUBLE, 4) AS informative_rate, count(*) > 1 AND (bool_and(is_informative) <> bool_or(is_informative) OR max(quality_rank) - min(quality_rank) >= 2) AS disagreement FROM latest GROUP BY 1""")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.feedback_summary(feedback(spark, sf_dir))


_EXT = "CASE o_orderkey % 9 WHEN 0 THEN 'deck.PDF' WHEN 1 THEN 'deck.pptx' WHEN 2 THEN 'data.xlsx' WHEN 3 THEN 'notes.exe' WHEN 4 THEN '' WHEN 5 THEN 'letter.docx' ELSE 'summary.pdf' END"


@query(f"""WITH p AS (SELECT o_orderkey AS package_id, CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE 'Firm ' || o_custkey END AS firm_name, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'Fund' END AS fund_name,
  CASE WHEN o_orderkey % 41 = 0 THEN '03/04/2024' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T10:00Z' END AS received_at, CASE o_orderkey % 29 WHEN 0 THEN ' ' WHEN 1 THEN 'v2' WHEN 2 THEN NULL ELSE 'v1' END AS version, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 3 END AS revision,
  CASE WHEN o_orderkey % 43 = 0 THEN 'fax' ELSE 'email' END AS source_channel, o_orderkey % 47 = 0 AS no_files, {_EXT} AS n0, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'primary' END AS r0, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'ref' END AS s0 FROM orders),
f AS (SELECT package_id, 0 AS k, n0 AS n, r0 AS r, s0 AS s FROM p WHERE NOT no_files UNION ALL SELECT package_id, 1, 'extra.txt', 'secondary', 'ref' FROM p WHERE NOT no_files), x AS (SELECT *, CASE WHEN contains(n, '.') THEN lower(split_part(n, '.', -1)) ELSE '' END AS ext FROM f)
SELECT package_id, 'missing_required_metadata' AS code, 'metadata.firm_name' AS path, 'error' AS severity FROM p WHERE trim(firm_name) = ''
UNION ALL SELECT package_id, 'missing_required_metadata', 'metadata.fund_name', 'error' FROM p WHERE fund_name IS NULL
UNION ALL SELECT package_id, 'invalid_source_channel', 'metadata.source_channel', 'error' FROM p WHERE source_channel = 'fax'
UNION ALL SELECT package_id, 'invalid_received_at', 'metadata.received_at', 'error' FROM p WHERE received_at LIKE '%/%'
UNION ALL SELECT package_id, 'invalid_contract_version', 'metadata.contract_version', 'error' FROM p WHERE version = ' '
UNION ALL SELECT package_id, 'unsupported_contract_version', 'metadata.contract_version', 'error' FROM p WHERE version = 'v2'
UNION ALL SELECT package_id, 'invalid_schema_revision', 'metadata.schema_revision', 'error' FROM p WHERE revision < 1
UNION ALL SELECT package_id, 'missing_files', 'files', 'error' FROM p WHERE no_files
UNION ALL SELECT package_id, 'missing_primary_document', 'files', 'error' FROM x GROUP BY 1 HAVING NOT bool_or(ext IN ('pdf', 'pptx'))
UNION ALL SELECT package_id, 'missing_file_name', 'files[' || k || '].file_name', 'error' FROM x WHERE n = ''
UNION ALL SELECT package_id, 'missing_file_role', 'files[' || k || '].role', 'error' FROM x WHERE r = '' AND n <> ''
UNION ALL SELECT package_id, 'unsupported_file_type', 'files[' || k || '].file_name', 'error' FROM x WHERE n <> '' AND ext NOT IN ('pdf', 'pptx', 'xlsx', 'docx', 'eml', 'txt', 'md')
UNION ALL SELECT package_id, 'missing_source_ref', 'files[' || k || '].source_ref', 'warning' FROM x WHERE s IS NULL AND ext IN ('pdf', 'pptx', 'xlsx', 'docx', 'eml', 'txt', 'md')""")
def intake_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    name = F.element_at(F.array(*[F.lit(x) for x in ("deck.PDF", "deck.pptx", "data.xlsx", "notes.exe", "", "letter.docx", *["summary.pdf"] * 3)]), (key % 9 + 1).cast("int"))
    metadata = F.struct(
        F.when(key % 31 == 0, " ").otherwise(F.concat(F.lit("Firm "), F.col("o_custkey").cast("string"))).alias("firm_name"),
        F.when(key % 37 != 0, "Fund").alias("fund_name"),
        F.when(key % 41 == 0, "03/04/2024").when(key % 2 == 0, day).otherwise(F.concat(day, F.lit("T10:00Z"))).alias("received_at"),
        F.when(key % 29 == 0, " ").when(key % 29 == 1, "v2").when(key % 29 > 2, "v1").alias("contract_version"),
        F.when(key % 23 == 0, 0).otherwise(3).alias("schema_revision"),
        F.when(key % 43 == 0, "fax").otherwise("email").alias("source_channel"),
    )
    first = F.struct(name.alias("file_name"), F.when(key % 13 == 0, "").otherwise("primary").alias("role"), F.when(key % 3 != 0, "ref").alias("source_ref"))
    second = F.struct(F.lit("extra.txt").alias("file_name"), F.lit("secondary").alias("role"), F.lit("ref").alias("source_ref"))
    files = F.when(key % 47 == 0, F.array().cast("array<struct<file_name:string,role:string,source_ref:string>>")).otherwise(F.array(first, second))
    return intake.intake_issues(table(spark, sf_dir, "orders").select(key.alias("package_id"), metadata.alias("metadata"), files.alias("files")))


@query("""WITH ent AS (SELECT s_suppkey AS k, 'ent_' || s_suppkey AS entity_id, s_name || ', L.P., Inc.' AS name, [CASE WHEN s_suppkey % 10 = 0 THEN 'Shared Name LLC' ELSE s_name || ' Partners' END] AS aliases FROM supplier),
known AS (SELECT DISTINCT entity_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(a)), '\\s+', ' ', 'g'), '([\\s,]*\\b(llc|l\\.l\\.c|lp|l\\.p|ltd|inc)\\.?)+[\\s,]*$', ''), '[\\s,]+$', '')) AS key FROM (SELECT entity_id, unnest(list_append(aliases, name)) AS a FROM ent)),
g AS (SELECT key, count(*) AS matches, min(entity_id) AS match FROM known GROUP BY 1),
n AS (SELECT c_custkey AS name_id, CASE c_custkey % 4 WHEN 0 THEN upper(s_name) || ' LTD' WHEN 1 THEN 'shared   name' WHEN 2 THEN s_name || ' Partners' ELSE c_name END AS name, CASE WHEN c_custkey % 20 = 7 THEN 'given_1' ELSE '' END AS given_id FROM customer JOIN supplier ON s_suppkey = 1 + c_custkey % (SELECT count(*) FROM supplier)),
j AS (SELECT n.*, matches, match, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(n.name)), '\\s+', ' ', 'g'), '([\\s,]*\\b(llc|l\\.l\\.c|lp|l\\.p|ltd|inc)\\.?)+[\\s,]*$', ''), '[\\s,]+$', '')) AS key FROM n LEFT JOIN g ON g.key = trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(n.name)), '\\s+', ' ', 'g'), '([\\s,]*\\b(llc|l\\.l\\.c|lp|l\\.p|ltd|inc)\\.?)+[\\s,]*$', ''), '[\\s,]+$', '')))
SELECT name_id, name, CASE WHEN given_id <> '' THEN 'given' WHEN matches > 1 THEN 'ambiguous' WHEN matches = 1 THEN 'matched' ELSE 'new' END AS status,
  CASE WHEN given_id <> '' THEN given_id WHEN matches > 1 THEN NULL WHEN matches = 1 THEN match ELSE 'firm_' || regexp_replace(regexp_replace(key, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS entity_id FROM j""")
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    key = F.col("s_suppkey")
    alias = F.when(key % 10 == 0, "Shared Name LLC").otherwise(F.concat(F.col("s_name"), F.lit(" Partners")))
    entities = supplier.select(F.concat(F.lit("ent_"), key.cast("string")).alias("entity_id"), F.concat(F.col("s_name"), F.lit(", L.P., Inc.")).alias("name"), F.array(alias).alias("aliases"))
    cust = F.col("c_custkey")
    joined = customer.join(supplier, key == 1 + cust % supplier.count())
    name = F.when(cust % 4 == 0, F.concat(F.upper("s_name"), F.lit(" LTD"))).when(cust % 4 == 1, "shared   name").when(cust % 4 == 2, F.concat(F.col("s_name"), F.lit(" Partners"))).otherwise(F.col("c_name"))
    names = joined.select(cust.alias("name_id"), name.alias("name"), F.when(cust % 20 == 7, "given_1").otherwise("").alias("given_id"))
    return intake.resolve_entities(names, entities, "firm")


_CONTENT_SQL = """'Manager - ' || p_name || '; Strategy Asset Class: ' || p_type || '; Management Fee ' || (p_size % 3) || '.5%; performance fee: 20%; ' || CASE WHEN p_partkey % 3 = 0 THEN 'AUM: $' || p_size || 'm; ' ELSE '' END || 'page 4 net return 1y -- ' || p_size || '.25%; Key Person Risk: low. ' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Benchmark: ' || p_brand ELSE '' END"""


def _fields_sql(patterns: tuple, source: str, strip: str = "") -> str:
    """SQL for the first match of each pattern in source(document_id, content)."""
    quoted = [(k, p.replace("'", "''"), sure) for k, p, sure in patterns]
    value = lambda p: f"trim(regexp_extract(content, '{p}', 1))"
    return " UNION ALL ".join(
        f"SELECT *, '{k}' AS key, {f'rtrim({value(p)}, {chr(39)}{strip}{chr(39)})' if strip else value(p)} AS value, {sure}::DOUBLE AS confidence, CAST(instr(content, regexp_extract(content, '{p}', 0)) AS INTEGER) AS start, trim(regexp_extract(content, '{p}', 0)) AS snippet FROM {source} WHERE regexp_matches(content, '{p}')"
        for k, p, sure in quoted
    )


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    parts = [F.lit("Manager - "), F.col("p_name"), F.lit("; Strategy Asset Class: "), F.col("p_type"), F.lit("; Management Fee "), (F.col("p_size") % 3).cast("string"), F.lit(".5%; performance fee: 20%; ")]
    aum = F.when(key % 3 == 0, F.concat(F.lit("AUM: $"), size, F.lit("m; "))).otherwise("")
    last = F.when(key % 2 == 0, F.concat(F.lit("\nBenchmark: "), "p_brand")).otherwise("")
    content = F.concat(*parts, aum, F.lit("page 4 net return 1y -- "), size, F.lit(".25%; Key Person Risk: low. "), last)
    return table(spark, sf_dir, "part").select(key.alias("document_id"), content.alias("content"))


@query(f"WITH d AS (SELECT p_partkey AS document_id, {_CONTENT_SQL} AS content FROM part), f AS ({_fields_sql(intake.FIELD_PATTERNS, 'd')}) SELECT document_id, key, value, confidence, start, snippet FROM f")
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.extract_fields(_contents(spark, sf_dir))


@query(f"""WITH d AS (SELECT p_partkey AS document_id, {_CONTENT_SQL} AS content FROM part), f AS ({_fields_sql(intake.PDF_PATTERNS, 'd', '.')})
SELECT document_id, key, value, confidence, CASE WHEN start > instr(content, 'page 4') THEN 4 ELSE 0 END AS page FROM f""")
def extract_pdf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.extract_pdf_fields(_contents(spark, sf_dir))


_SLIDES_SQL = "d AS (SELECT l_orderkey AS document_id, l_linenumber AS slide, CASE l_partkey % 4 WHEN 0 THEN 'Management Fee: ' || l_suppkey || '.5%' WHEN 1 THEN 'AUM- $' || l_suppkey || 'm; key person risk: high' WHEN 2 THEN 'net return 1y:' || l_linenumber || '.5%' ELSE 'aum 5' END AS content FROM lineitem)"


@query(f"WITH {_SLIDES_SQL}, f AS ({_fields_sql(intake.SLIDE_PATTERNS, 'd')}) SELECT document_id, key, arg_min(value, (slide, value)) AS value, min(confidence) AS confidence, min(slide) AS slide FROM f GROUP BY 1, 2")
def extract_slide_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, line = F.col("l_partkey"), F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    content = (
        F.when(part % 4 == 0, F.concat(F.lit("Management Fee: "), supplier, F.lit(".5%")))
        .when(part % 4 == 1, F.concat(F.lit("AUM- $"), supplier, F.lit("m; key person risk: high")))
        .when(part % 4 == 2, F.concat(F.lit("net return 1y:"), line.cast("string"), F.lit(".5%")))
        .otherwise("aum 5")
    )
    return intake.extract_slide_fields(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), line.alias("slide"), content.alias("content")))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 7 WHEN 0 THEN ' DDQ' WHEN 1 THEN ' Tear Sheet' WHEN 2 THEN ' our Monthly Letter and pitchbook' WHEN 3 THEN ' Pitch Book' ELSE '' END AS content FROM documents), l AS (SELECT doc_id, lower(content) AS c FROM t)
SELECT doc_id, CASE WHEN contains(c, 'ddq') OR contains(c, 'due diligence questionnaire') THEN 'ddq' WHEN contains(c, 'tear sheet') OR contains(c, 'tearsheet') OR contains(c, 'fact sheet') THEN 'tear_sheet'
  WHEN contains(c, 'monthly letter') OR contains(c, 'monthly commentary') THEN 'monthly_letter' WHEN contains(c, 'pitchbook') OR contains(c, 'pitch book') THEN 'pitchbook' END AS doc_type FROM l""")
def classify_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in (" DDQ", " Tear Sheet", " our Monthly Letter and pitchbook", " Pitch Book", "", "", "")]), (F.col("doc_id") % 7 + 1).cast("int"))
    content = F.concat(F.coalesce("text", F.lit("")), tail)
    return table(spark, sf_dir, "documents").select("doc_id", intake.classify_doc_type(content).alias("doc_type"))


@query("""WITH a AS (SELECT source AS document_key, coalesce(text, '') AS content, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 100 AS INTEGER)) AS received_at, doc_id AS ord FROM documents),
h AS (SELECT *, sha256(content) AS sha256, row_number() OVER (PARTITION BY document_key, sha256(content) ORDER BY received_at, ord) AS rn, count(*) OVER (PARTITION BY document_key, sha256(content)) AS arrivals FROM a)
SELECT document_key, sha256, received_at, arrivals, CAST(row_number() OVER (PARTITION BY document_key ORDER BY received_at, ord) AS INTEGER) AS version, strftime(received_at, '%Y-%m-%d') || ':' || left(sha256, 16) AS version_id FROM h WHERE rn = 1""")
def doc_versions_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampadd(DAY, doc_id % 100, timestamp_ntz'2024-01-01')")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("document_key"), F.coalesce("text", F.lit("")).alias("content"), at.alias("received_at"), F.col("doc_id").alias("ord"))
    return intake.document_versions(rows)
