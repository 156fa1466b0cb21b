"""Queries over extraction quality; line items and documents stand for extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import quality
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

KEYS = ("terms.management_fee", "performance.net_return_1y", "operations.aum", "commentary.market_update", "operations.inception_date")
_KEY_SQL = "CASE l_partkey % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KEYS)) + " END"
_TYPES = (*quality.PROFILES, "memo")
_TYPE_SQL = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_TYPES)) + " END"
_PROFILES_SQL = "profiles(doc_type, key_fields, mandatory, least_coverage) AS (VALUES " + ", ".join(f"('{k}', {list(a)}, {list(b)}, {c}::DOUBLE)" for k, (a, b, c) in (quality.PROFILES | {"memo": quality.BASE_PROFILE}).items()) + ")"
FIELDS_SQL = f"""fields AS (SELECT l_orderkey AS document_id, {_KEY_SQL} AS key, ((l_suppkey * 7 + l_partkey * 3) % 101) / 100.0::DOUBLE AS confidence, l_partkey * 100 + l_linenumber AS ord FROM lineitem)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.col("l_partkey") % 5 + 1).cast("int"))
    confidence = ((F.col("l_suppkey") * 7 + F.col("l_partkey") * 3) % 101) / F.lit(100.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), key.alias("key"), confidence.alias("confidence"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("ord"))


@query(f"""WITH {FIELDS_SQL}, {_PROFILES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY confidence DESC, ord) AS rn, count(*) OVER (PARTITION BY document_id, key) AS copies FROM fields),
best AS (SELECT * FROM b WHERE rn = 1), docs AS (SELECT o_orderkey AS document_id, {_TYPE_SQL} AS doc_type FROM orders),
kf AS (SELECT document_id, k, doc_type FROM docs JOIN profiles USING (doc_type), unnest(key_fields) AS u(k)),
cov AS (SELECT kf.document_id, count(*) FILTER (best.confidence >= 0.75) / count(*)::DOUBLE AS coverage FROM kf LEFT JOIN best ON best.document_id = kf.document_id AND best.key = kf.k GROUP BY 1),
mf AS (SELECT document_id, unnest(mandatory) AS k, generate_subscripts(mandatory, 1) AS i FROM docs JOIN profiles USING (doc_type)),
fails AS (SELECT mf.document_id, 0 AS part, i, '' AS k, CASE WHEN confidence IS NULL THEN 'missing_mandatory_field:' || mf.k ELSE 'confidence_below_threshold:' || mf.k END AS reason FROM mf LEFT JOIN best ON best.document_id = mf.document_id AND best.key = mf.k WHERE confidence IS NULL OR confidence < 0.6
  UNION ALL SELECT document_id, 1, 0, key, 'duplicate_field_key:' || key FROM best WHERE copies > 1),
r AS (SELECT document_id, string_agg(reason, ';' ORDER BY part, i, k) AS reasons FROM fails GROUP BY 1), acc AS (SELECT document_id, count(*) FILTER (confidence >= 0.85) AS auto_accepted FROM best GROUP BY 1)
SELECT d.document_id, d.doc_type, round(coverage, 6) AS coverage, coalesce(auto_accepted, 0) AS auto_accepted, coalesce(reasons, CASE WHEN coverage < least_coverage THEN 'low_key_field_coverage' END) IS NULL AS auto_pass,
  coalesce(reasons, CASE WHEN coverage < least_coverage THEN 'low_key_field_coverage' END) AS reason
FROM docs d JOIN profiles USING (doc_type) JOIN cov USING (document_id) LEFT JOIN r USING (document_id) LEFT JOIN acc USING (document_id)""")
def threshold_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in _TYPES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), kind.alias("doc_type"))
    return quality.threshold_decisions(fields(spark, sf_dir), documents, quality.profile_table(spark)).withColumn("coverage", F.round("coverage", 6))


def observations(spark: SparkSession, sf_dir: str, *ord_: Column) -> DataFrame:
    order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    value = (
        F.when(order % 50 == 0, "n/a")
        .when(order % 3 == 0, F.concat(F.lit("$"), (part % 90 + 10).cast("string"), F.lit(" million")))
        .otherwise(F.concat((part % 90 + 10 + supplier % 3).cast("string"), F.lit("M")))
    )
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(part.alias("entity"), F.lit("operations.aum").alias("key"), F.concat(F.lit("s"), supplier.cast("string")).alias("source"), (order * 13 % 101 / F.lit(100.0)).alias("confidence"), value.alias("value"), *[o.alias("ord") for o in ord_])


_OBS_SQL = """obs AS (SELECT l_partkey AS entity, 'operations.aum' AS key, 's' || l_suppkey AS source, (l_orderkey * 13 % 101) / 100.0::DOUBLE AS confidence,
  CASE WHEN l_orderkey % 50 = 0 THEN 'n/a' WHEN l_orderkey % 3 = 0 THEN '$' || CAST(l_partkey % 90 + 10 AS VARCHAR) || ' million' ELSE CAST((l_partkey % 90 + 10) + (l_suppkey % 3) AS VARCHAR) || 'M' END AS value FROM lineitem)"""


@query(f"""WITH {_OBS_SQL}, p AS (SELECT *, CASE WHEN value = 'n/a' THEN NULL ELSE CAST(regexp_extract(value, '[0-9]+') AS DOUBLE) * 1e6 END AS number FROM obs),
g AS (SELECT entity, key, count(*) AS n, max({{'confidence': confidence, 'source': source, 'value': value}}) AS accepted, min(number) AS low, max(number) AS high,
  coalesce(string_agg(DISTINCT CASE WHEN number IS NULL THEN source END, ',' ORDER BY CASE WHEN number IS NULL THEN source END), '') AS unparsed FROM p GROUP BY 1, 2 HAVING count(*) > 1),
d AS (SELECT *, coalesce(abs(low - high) / greatest(abs(low), abs(high), 1e-12) * 100, 0) AS diff FROM g),
r AS (SELECT *, CASE WHEN unparsed <> '' THEN 'unparseable:' || key || ':' || unparsed WHEN diff > 5 THEN 'disagreement:' || key END AS reason FROM d)
SELECT entity, key, n, accepted.source AS accepted_source, accepted.value AS accepted_value, round(diff, 6) AS difference_percent, reason IS NOT NULL AS escalate, reason FROM r""")
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cross_check(observations(spark, sf_dir)).withColumn("difference_percent", F.round("difference_percent", 6))


@query(f"""WITH {_OBS_SQL.replace("SELECT l_partkey AS entity", "SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey AS entity")},
p AS (SELECT ord, entity, key, source, value, CAST(regexp_extract(value, '[0-9]+') AS DOUBLE) * 1e6 AS number FROM obs WHERE value <> 'n/a'),
j AS (SELECT a.entity, a.key, a.source AS left_source, a.value AS left_value, b.source AS right_source, b.value AS right_value, abs(a.number - b.number) / greatest(a.number, b.number) * 100 AS d,
  row_number() OVER (PARTITION BY a.entity, a.key ORDER BY a.ord, a.source, a.value, b.ord, b.source, b.value) AS n
  FROM p a JOIN p b ON a.entity = b.entity AND a.key = b.key AND (a.ord, a.source, a.value) < (b.ord, b.source, b.value) WHERE abs(a.number - b.number) / greatest(a.number, b.number) * 100 > 2)
SELECT entity, key, left_source, left_value, right_source, right_value, round(d, 6) AS difference_percent, printf('cross_check_disagreement:%s:%s!=%s:%.4f%%>2.0000%%', key, left_source, right_source, d) AS reason FROM j WHERE n = 1""")
def first_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return quality.first_disagreements(rows, 2.0).withColumn("difference_percent", F.round("difference_percent", 6))


_EXPECTED_SQL = """expected AS (SELECT o_orderkey AS document_id, k AS key, o_orderpriority || ' ' || k AS value FROM orders, (VALUES ('a'), ('b'), ('c')) t(k) WHERE o_orderkey % 13 <> 0 OR k <> 'c'),
actual AS (SELECT o_orderkey AS document_id, k AS key, CASE WHEN o_orderkey % 7 = 0 AND k = 'a' THEN 'other' ELSE '  ' || upper(o_orderpriority) || '   ' || k END AS value FROM orders, (VALUES ('a'), ('b'), ('c')) t(k) WHERE o_orderkey % 11 <> 0 OR k <> 'b'
  UNION ALL SELECT o_orderkey, 'a', o_orderpriority || ' a' FROM orders WHERE o_orderkey % 17 = 0),
one AS (SELECT document_id, key, min(value) AS actual, count(*) AS copies FROM actual GROUP BY 1, 2),
outcomes AS (SELECT document_id, key, e.value AS expected, actual, copies, CASE WHEN e.value IS NULL THEN 'unexpected' WHEN actual IS NULL THEN 'missing'
  WHEN copies = 1 AND lower(regexp_replace(trim(e.value), '\\s+', ' ', 'g')) = lower(regexp_replace(trim(actual), '\\s+', ' ', 'g')) THEN 'matched' ELSE 'mismatched' END AS outcome FROM expected e FULL JOIN one USING (document_id, key))"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_orderpriority", F.explode(F.array(*[F.lit(k) for k in "abc"])).alias("key"))
    doc, key, text = F.col("document_id"), F.col("key"), F.col("o_orderpriority")
    expected = each.where((doc % 13 != 0) | (key != "c")).select("document_id", "key", F.concat_ws(" ", text, key).alias("value"))
    read = F.when((doc % 7 == 0) & (key == "a"), "other").otherwise(F.concat(F.lit("  "), F.upper(text), F.lit("   "), key))
    actual = each.where((doc % 11 != 0) | (key != "b")).select("document_id", "key", read.alias("value"))
    again = each.where((doc % 17 == 0) & (key == "a")).select("document_id", "key", F.concat_ws(" ", text, key).alias("value"))
    return quality.field_outcomes(expected, actual.unionByName(again))


@query(f"WITH {_EXPECTED_SQL} SELECT * FROM outcomes")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir)


@query(f"""WITH {_EXPECTED_SQL}, n AS (SELECT key, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'mismatched') AS mismatched, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'unexpected') AS unexpected FROM outcomes GROUP BY 1)
SELECT *, round(matched / (matched + mismatched + unexpected)::DOUBLE, 6) AS precision, round(matched / (matched + mismatched + missing)::DOUBLE, 6) AS recall, round(2 * matched / (2 * matched + 2 * mismatched + unexpected + missing)::DOUBLE, 6) AS f1 FROM n""")
def extraction_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.extraction_f1(outcomes(spark, sf_dir))


_JUDGED_SQL = """judged AS (SELECT source, ((doc_id * 37) % 101) / 100.0::DOUBLE AS confidence, CASE WHEN quality IS NOT NULL THEN quality = 1 END AS correct FROM documents LEFT JOIN labels USING (doc_id))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as extractions of a made-up confidence; the quality label tells whether one is right."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("source", (F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@query(f"""WITH {_JUDGED_SQL}, n AS (SELECT source, count(*) AS n, count(correct) AS known, count(*) FILTER (correct) AS right, count(*) FILTER (confidence >= 0.85 AND correct IS NOT NULL) AS auto_n, count(*) FILTER (confidence >= 0.85 AND correct) AS auto_right FROM judged GROUP BY 1),
r AS (SELECT *, round(coalesce("right" / nullif(known, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(auto_right / nullif(auto_n, 0)::DOUBLE, 0), 4) AS auto_precision, round(coalesce(auto_right / nullif("right", 0)::DOUBLE, 0), 4) AS auto_recall FROM n)
SELECT *, CASE WHEN auto_n = 0 THEN 'hold' WHEN auto_precision < 0.8 THEN 'raise' WHEN auto_precision > 0.97 THEN 'consider_lowering' ELSE 'hold' END AS suggestion FROM r""".replace(" AS right,", ' AS "right",'))
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.calibration_report(judged(spark, sf_dir), "source")


@query(f"""WITH {_JUDGED_SQL}, b AS (SELECT CASE WHEN confidence < 0.5 THEN '0.00-0.50' WHEN confidence < 0.7 THEN '0.50-0.70' WHEN confidence < 0.85 THEN '0.70-0.85' ELSE '0.85-1.00' END AS bucket, confidence, CAST(correct AS DOUBLE) AS c FROM judged WHERE correct IS NOT NULL)
SELECT bucket, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, round(avg(c), 4) AS accuracy, round(avg(confidence) - avg(c), 4) AS gap FROM b GROUP BY 1""")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.confidence_buckets(judged(spark, sf_dir))
