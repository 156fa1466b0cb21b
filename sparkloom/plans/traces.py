"""Queries on trace contexts; orders stand for contexts, events for spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import traces
from sparkloom.plans.registry import query, shared_folder
from sparkloom.sources.tables import table

PREFIX = "x-trace-"


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' ' ELSE 'trace_' || o_orderkey END AS trace, CASE WHEN o_orderkey % 2 = 0 THEN 'run_' || o_custkey ELSE '' END AS run, CASE WHEN o_orderkey % 3 = 0 THEN 'span_' || o_custkey END AS span, o_orderkey % 5 > 0 AS tagged, o_orderpriority AS p, o_orderstatus || '"\\é' AS s FROM orders)
SELECT o_orderkey, 'kept=yes' || '|x-trace-id=' || trace || CASE WHEN span IS NULL THEN '' ELSE '|x-trace-parent-span-id=' || span END || CASE WHEN run = '' THEN '' ELSE '|x-trace-run-id=' || run END || CASE WHEN tagged THEN '|x-trace-tags={"priority": "' || p || '", "status": "' || replace(replace(replace(s, '\\', '\\\\'), '"', '\\"'), 'é', '\\u00e9') || '"}' ELSE '' END AS carrier,
  CASE WHEN trim(trace) <> '' THEN trace END AS trace_id, CASE WHEN trim(trace) <> '' THEN nullif(run, '') END AS run_id, CASE WHEN trim(trace) <> '' THEN span END AS parent_span_id, CASE WHEN trim(trace) <> '' THEN CASE WHEN tagged THEN 'priority=' || p || '|status=' || s ELSE '' END END AS tags FROM o""")
def trace_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inject writes into a carrier that held a key, and what extract reads back from it."""
    key = F.col("o_orderkey")
    tags = F.create_map(F.lit("status"), F.concat("o_orderstatus", F.lit('"\\é')), F.lit("priority"), F.col("o_orderpriority"))
    made = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, " ").otherwise(F.concat(F.lit("trace_"), key.cast("string"))).alias("trace"),
        F.when(key % 2 == 0, F.concat(F.lit("run_"), F.col("o_custkey").cast("string"))).otherwise("").alias("run"),
        F.when(key % 3 == 0, F.concat(F.lit("span_"), F.col("o_custkey").cast("string"))).alias("span"),
        F.when(key % 5 > 0, tags).otherwise(F.create_map().cast(traces.NO_TAGS)).alias("tags"),
    )
    held = F.create_map(F.lit("kept"), F.lit("yes"), F.lit(PREFIX + "id"), F.lit("before"))
    carrier = traces.inject(PREFIX, F.col("tags"), F.col("trace"), F.col("run"), F.lit(None).cast("string"), F.col("span"), carrier=held)
    written = made.select("o_orderkey", carrier.alias("carrier")).withColumn("c", traces.extract(PREFIX, F.col("carrier")))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat_ws("=", x["key"], x["value"])), "|")
    return written.select("o_orderkey", flat("carrier").alias("carrier"), "c.trace_id", "c.run_id", "c.parent_span_id", flat("c.tags").alias("tags"))


@query("""WITH RECURSIVE s AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 97 = 3 THEN -1 WHEN event_id % 101 = 5 THEN event_id + 2 ELSE event_id - 1 - event_id % 3 END AS parent, CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) END AS usr, event_type FROM events),
p AS (SELECT s.*, s.parent IS NOT NULL AND u.event_id IS NULL AS lost FROM s LEFT JOIN events u ON u.event_id = s.parent),
t AS (SELECT event_id, event_id AS root, 0 AS depth, usr, lost FROM p WHERE parent IS NULL OR lost UNION ALL SELECT p.event_id, t.root, t.depth + 1, coalesce(p.usr, t.usr), p.lost FROM p JOIN t ON p.parent = t.event_id AND NOT p.lost)
SELECT p.event_id AS span_id, t.root, t.depth, CASE WHEN t.root IS NULL THEN p.usr ELSE t.usr END AS user_tag, p.event_type AS type_tag, CASE WHEN t.root IS NULL THEN 'cycle' WHEN p.lost THEN 'orphan' END AS issue FROM p LEFT JOIN t USING (event_id)""")
def trace_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and inherited tags of spans with chains of many levels, lost parents and cycles."""
    key = F.col("event_id")
    parent = F.when(key % 50 == 0, None).when(key % 97 == 3, -1).when(key % 101 == 5, key + 2).otherwise(key - 1 - key % 3)
    own = F.create_map(F.lit("type"), F.col("event_type"))
    tags = F.when(key % 4 == 0, F.map_concat(own, F.create_map(F.lit("user"), F.col("user_id").cast("string")))).otherwise(own)
    spans = table(spark, sf_dir, "events").select(key.alias("span_id"), parent.alias("parent_id"), tags.alias("tags"))
    out = traces.trees(spans, shared_folder(spark))
    return out.select("span_id", "root", "depth", F.try_element_at("tags", F.lit("user")).alias("user_tag"), F.try_element_at("tags", F.lit("type")).alias("type_tag"), "issue")
