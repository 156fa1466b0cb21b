"""Queries over identities, stored records and document types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import identities
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


@query("SELECT c_custkey AS name_id, trim(regexp_replace(lower(replace(c_name, '#', '  ') || CASE WHEN c_custkey % 2 = 0 THEN ' 12 STRASSE' ELSE ' fi' END), '\\s+', ' ', 'g')) AS key FROM customer")
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.when(F.col("c_custkey") % 2 == 0, " １２ Straße").otherwise("　ﬁ")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name_id"), identities.plain_name(F.concat(F.replace("c_name", F.lit("#"), F.lit("  ")), wide)).alias("key"))


@query("""WITH e AS (SELECT p_partkey AS fund_id, 'f1' AS firm_id, p_name AS fund_name, p_type AS strategy, CASE WHEN p_partkey % 2 = 0 THEN 'credit' END AS asset_class FROM part), i AS (SELECT l_partkey + CASE WHEN l_partkey % 9 = 0 THEN 1000000 ELSE 0 END AS fund_id, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'f2' END AS firm_id, 'new name' AS fund_name, CASE WHEN l_partkey % 4 = 0 THEN 'macro' END AS strategy, CASE WHEN l_partkey % 5 = 0 THEN 'equity' END AS asset_class FROM (SELECT DISTINCT l_partkey FROM lineitem))
SELECT fund_id, coalesce(nullif(i.firm_id, ''), e.firm_id) AS firm_id, coalesce(e.fund_name, i.fund_name) AS fund_name, coalesce(i.strategy, e.strategy) AS strategy, coalesce(i.asset_class, e.asset_class) AS asset_class FROM e FULL JOIN i USING (fund_id)""")
def merged_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, part = F.col("p_partkey"), F.col("l_partkey")
    existing = table(spark, sf_dir, "part").select(key.alias("fund_id"), F.lit("f1").alias("firm_id"), F.col("p_name").alias("fund_name"), F.col("p_type").alias("strategy"), F.when(key % 2 == 0, "credit").alias("asset_class"))
    incoming = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().select(
        (part + F.when(part % 9 == 0, 1_000_000).otherwise(0)).alias("fund_id"), F.when(part % 3 == 0, "").otherwise("f2").alias("firm_id"), F.lit("new name").alias("fund_name"), F.when(part % 4 == 0, "macro").alias("strategy"), F.when(part % 5 == 0, "equity").alias("asset_class")
    )
    return identities.merged_funds(existing, incoming)


@query("""WITH a AS (SELECT o_orderkey AS document_id, 'f' || o_custkey AS f, o_orderpriority AS h, 'email' AS c FROM orders), b AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 5 = 0 THEN 'g' ELSE 'f' || o_custkey END AS f, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS h, CASE WHEN o_orderkey % 7 > 0 THEN 'email' END AS c FROM orders)
SELECT document_id, concat_ws(', ', CASE WHEN a.f <> b.f THEN 'fund_id=' || a.f || '->' || b.f END, CASE WHEN a.h <> b.h THEN 'file_hash=' || a.h || '->' || b.h END, CASE WHEN b.c IS NULL THEN 'source_channel=email->None' END) AS mismatches FROM a JOIN b USING (document_id) WHERE a.f <> b.f OR a.h <> b.h OR b.c IS NULL""")
def document_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    fund = F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    existing = orders.select(key.alias("document_id"), fund.alias("fund_id"), F.col("o_orderpriority").alias("file_hash"), F.lit("email").alias("source_channel"))
    incoming = orders.select(key.alias("document_id"), F.when(key % 5 == 0, "g").otherwise(fund).alias("fund_id"), F.when(key % 3 == 0, "new").otherwise(F.col("o_orderpriority")).alias("file_hash"), F.when(key % 7 > 0, "email").alias("source_channel"))
    return identities.document_collisions(existing, incoming)


@query("""WITH f AS (SELECT o_orderkey AS package_id, [CASE WHEN o_orderkey % 2 = 0 THEN 'd1' END, 'd1', ''] AS ids FROM orders), e AS (SELECT package_id, unnest(ids) AS id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS i FROM f), n AS (SELECT package_id, i, coalesce(nullif(id, ''), package_id || ':doc:' || i) AS document_id FROM e)
SELECT package_id, i, document_id, row_number() OVER (PARTITION BY package_id, document_id ORDER BY i) > 1 AS duplicate FROM n""")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    one = lambda c: F.struct(c.alias("document_id"))
    files = F.array(one(F.when(key % 2 == 0, "d1")), one(F.lit("d1")), one(F.lit("")))
    return identities.document_ids(table(spark, sf_dir, "orders").select(key.alias("package_id"), files.alias("files")))


@query("""WITH n AS (SELECT c_custkey AS name_id, c_nationkey AS firm_id, CAST(c_custkey % 40 AS VARCHAR) AS key FROM customer), e AS (SELECT DISTINCT s_nationkey AS firm_id, CAST(s_suppkey % 40 AS VARCHAR) AS key, 's' || s_suppkey AS entity_id FROM supplier), g AS (SELECT firm_id, key, count(*) AS m, min(entity_id) AS e FROM e GROUP BY 1, 2)
SELECT name_id, firm_id, key, coalesce(m, 0) AS matches, CASE WHEN m = 1 THEN e END AS entity_id FROM n LEFT JOIN g USING (firm_id, key)""")
def scoped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name_id"), F.col("c_nationkey").alias("firm_id"), (F.col("c_custkey") % 40).cast("string").alias("key"))
    entities = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("firm_id"), (F.col("s_suppkey") % 40).cast("string").alias("key"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    return identities.scoped_matches(names, entities, "firm_id")


@query("""WITH t AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s FROM events)
SELECT event_id, strftime(CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 150 MINUTES ELSE ts END, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc, CASE event_id % 3 WHEN 0 THEN strftime(ts - INTERVAL 150 MINUTES, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS zoned,
  CASE WHEN event_id % 2 = 0 THEN '2024-02-29' ELSE left(s, 10) END AS version_date FROM t""")
def utc_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    own = F.when(key % 3 == 0, F.concat(text, F.lit("+02:30"))).when(key % 3 == 1, F.concat(text, F.lit("Z"))).otherwise(text)
    explicit = _pick(("2024-02-29", "2023-02-29"), key % 2)
    return table(spark, sf_dir, "events").select("event_id", identities.utc_text(own).alias("utc"), identities.utc_z_text(own).alias("zoned"), identities.version_date(explicit, own).alias("version_date"))


@query("""WITH a AS (SELECT event_id AS artifact_id, user_id AS document_id, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS page, CASE WHEN event_id % 3 = 1 THEN event_id % 4 END AS slide FROM events)
SELECT document_id, artifact_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY coalesce(page, 0), coalesce(slide, 0), artifact_id) AS INTEGER) AS place FROM a""")
def artifact_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(key.alias("artifact_id"), F.col("user_id").alias("document_id"), F.when(key % 3 == 0, key % 5).alias("page"), F.when(key % 3 == 1, key % 4).alias("slide"))
    return identities.ordered_within(rows, "document_id", F.coalesce("page", F.lit(0)), F.coalesce("slide", F.lit(0)), F.col("artifact_id")).select("document_id", "artifact_id", "place")


@query("SELECT event_type AS artifact_id, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, user_id, event_id) AS INTEGER) AS place FROM events")
def feedback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "artifact_id")
    return identities.ordered_within(rows, "artifact_id", F.col("ts"), F.col("user_id"), F.col("event_id")).select("artifact_id", "event_id", "place")


@query("SELECT user_id AS field_id, event_id AS correction_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM events")
def correction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("field_id"), "ts", F.col("event_id").alias("correction_id"))
    return identities.ordered_within(rows, "field_id", F.col("ts"), F.col("correction_id")).select("field_id", "correction_id", "place")


@query("SELECT s_nationkey AS firm_id, s_suppkey AS fund_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) AS INTEGER) AS place FROM supplier")
def fund_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("firm_id"), F.col("s_suppkey").alias("fund_id"), "s_name")
    return identities.ordered_within(rows, "firm_id", F.col("s_name"), F.col("fund_id")).select("firm_id", "fund_id", "place")


@query("SELECT l_orderkey AS document_id, l_partkey, l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS INTEGER) AS place FROM lineitem")
def provenance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "document_id")
    return identities.ordered_within(rows, "document_id", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_extendedprice")).select("document_id", "l_partkey", "l_suppkey", "l_linenumber", "place")


@query("SELECT pointer, corrected_value, event_id FROM (SELECT 'documents.' || (user_id % 50) || '.file_name' AS pointer, event_type AS corrected_value, event_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_by_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointer = F.concat(F.lit("documents."), (F.col("user_id") % 50).cast("string"), F.lit(".file_name"))
    rows = table(spark, sf_dir, "events").select(pointer.alias("pointer"), F.col("event_type").alias("corrected_value"), "event_id", "ts")
    return identities.latest_by(rows, "pointer", "ts", "event_id").select("pointer", "corrected_value", "event_id")


@query("SELECT o_orderpriority AS asset_class, o_custkey AS manager_id, min(o_orderkey) AS first_ord, arg_max(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1, 2")
def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("asset_class"), F.col("o_custkey").alias("manager_id"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("score"))
    return identities.latest_scores(rows)


@query("""WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'documents.' || user_id || '.file_name' WHEN 1 THEN 'documents.-1.file_name' WHEN 2 THEN 'documents.' || user_id || '.size' WHEN 3 THEN 'funds.1.name' ELSE 'documents.' || user_id END AS pointer, user_id FROM events)
SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN 'invalid-pointer-format' WHEN event_id % 5 = 1 OR c_custkey IS NULL THEN 'unknown-document' ELSE 'unknown-field' END AS issue FROM c LEFT JOIN customer ON c_custkey = user_id WHERE NOT (event_id % 5 = 0 AND c_custkey IS NOT NULL)""")
def pointer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    pointer = F.when(key % 5 == 0, F.concat(F.lit("documents."), user, F.lit(".file_name"))).when(key % 5 == 1, "documents.-1.file_name").when(key % 5 == 2, F.concat(F.lit("documents."), user, F.lit(".size"))).when(key % 5 == 3, "funds.1.name").otherwise(F.concat(F.lit("documents."), user))
    corrections = table(spark, sf_dir, "events").select("event_id", pointer.alias("pointer"))
    return identities.pointer_issues(corrections, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id")))


_LIBRARY = {"stub_monthly_letter": "monthly_letter", "quarterly_report": "tear_sheet", "due-diligence": "ddq"}
_TAILS = (" see the Monthly  Letter.", " quarterly-reports", " a due_diligence file", " STUB monthly_letter", "", " Quarterly Report")


@query(f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 6 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_TAILS))} END) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?:^|[^a-z0-9])monthly[\\s_-]+letter(?:[^a-z0-9]|$)') THEN 'monthly_letter' WHEN regexp_matches(t, '(?:^|[^a-z0-9])quarterly[\\s_-]+report(?:[^a-z0-9]|$)') THEN 'tear_sheet' WHEN regexp_matches(t, '(?:^|[^a-z0-9])due[\\s_-]+diligence(?:[^a-z0-9]|$)') THEN 'ddq' END AS doc_type FROM t""")
def library_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.coalesce("text", F.lit("")), _pick(_TAILS, F.pmod("doc_id", F.lit(6))))
    return table(spark, sf_dir, "documents").select("doc_id", identities.library_type(content, _LIBRARY).alias("doc_type"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_size * 1000 + 250.5)::DOUBLE * 1e6 WHEN 1 THEN p_size::DOUBLE WHEN 3 THEN -1000.0::DOUBLE * p_size WHEN 5 THEN CAST('0.' || p_size AS DOUBLE) END AS number FROM part""")
def coverage_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written around a part's own size, and names without a number."""
    size = F.col("p_size").cast("string")
    forms = (F.concat(F.lit("$"), size, F.lit(",250.5 m")), F.concat(F.lit(" "), size, F.lit("%")), F.concat(F.lit("about "), size), F.concat(F.lit("-"), size, F.lit("k")), F.col("p_name"), F.concat(F.lit("€."), size))
    value = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", identities.coverage_number(value).alias("number"))


@query("""SELECT event_id AS ord, 'artifact_id' AS issue FROM events WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 'reviewer' FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 'timestamp_required' FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 'timestamp' FROM events WHERE event_id % 4 = 2
UNION ALL SELECT event_id, 'is_informative' FROM events WHERE event_id % 13 = 0 UNION ALL SELECT event_id, 'quality_rank' FROM events WHERE event_id % 8 IN (0, 6, 7)""")
def feedback_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        key.alias("ord"),
        F.when(key % 11 > 0, "a").alias("artifact_id"),
        F.when(key % 7 == 0, "  ").otherwise("r").alias("reviewer"),
        _pick(("2024-05-01T10:00:00Z", " ", "2024-05-01T10:00:00", "2024-05-01T10:00:00+02:00"), key % 4).alias("timestamp"),
        F.when(key % 13 > 0, True).alias("is_informative"),
        (key % 8).cast("int").alias("quality_rank"),
    )
    return identities.feedback_issues(rows)
