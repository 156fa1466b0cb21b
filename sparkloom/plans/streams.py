"""Streaming queries, drained over the events table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.plans.registry import query, shared_folder
from sparkloom.plans.workflow import LIFECYCLE_SQL
from sparkloom.streaming import events, spans


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last count of each window; the table's files are in no order of time, so no row may be late."""
    rows = events.drained(events.windowed_counts(events.event_stream(spark, sf_dir), late="3650 days"), shared_folder(spark), "update")
    last = F.row_number().over(Window.partitionBy("start", "event_type").orderBy(F.col("batch").desc()))
    return rows.withColumn("_n", last).where("_n = 1").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(LIFECYCLE_SQL.replace("ORDER BY ts, event_id", "ORDER BY event_id"))
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each item after all events, in the order of arrival."""
    key = F.col("event_id")
    to = F.element_at(F.array(*[F.lit(s) for s in ("received", "processing", "completed", "escalated")]), (key % 4 + 1).cast("int"))
    moves = events.event_stream(spark, sf_dir).select((F.col("user_id") * 100 + key % 50).alias("item_id"), key.alias("ord"), to.alias("to_state"))
    rows = events.drained(events.lifecycle_stream(moves), shared_folder(spark), "update")
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("batch").desc()))
    return rows.withColumn("_n", last).where("_n = 1").select("item_id", "state", "moves", "illegal")


def _at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the first batch: the table's files are in no order of time, and so none of its rows is late."""
    return spark.readStream.schema(events.SCHEMA).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))


@query("""WITH s AS (SELECT event_id AS span_id, ts AS started_at FROM events WHERE event_id % 2 = 0), e AS (SELECT event_id - 1 - 2 * (event_id % 5) AS span_id, ts AS ended_at FROM events WHERE event_id % 2 = 1),
w AS (SELECT least((SELECT max(started_at) FROM s), (SELECT max(ended_at) FROM e)) - INTERVAL 10 MINUTE AS mark)
SELECT s.span_id, started_at, ended_at FROM s LEFT JOIN e ON e.span_id = s.span_id AND ended_at BETWEEN started_at AND started_at + INTERVAL 30 MINUTE, w WHERE ended_at IS NOT NULL OR started_at + INTERVAL 30 MINUTE < mark""")
def stream_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their ends, and those known to be lost; a span that can still end when the events stop is not told of."""
    key = F.col("event_id")
    rows = _at_once(spark, sf_dir).select(F.when(key % 2 == 0, key).otherwise(key - 1 - 2 * (key % 5)).alias("span_id"), F.when(key % 2 == 0, "start").otherwise("end").alias("kind"), "at")
    out = events.drained(spans.paired_spans(rows, "30 MINUTES"), shared_folder(spark))
    return out.select("span_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"))


@query("""WITH a AS (SELECT user_id * 100 + day(ts) AS item_id, event_id AS ord, ts, event_type AS provider, value > 20 AS ok FROM events WHERE event_type IN ('click', 'view', 'error')),
f AS (SELECT item_id, provider, min(ord) AS ord, arg_min(ok, ord) AS ok FROM a GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ord) AS k FROM f),
t AS (SELECT item_id, any_value(provider) FILTER (k = 1) AS p1, any_value(ok) FILTER (k = 1) AS ok1, any_value(provider) FILTER (k = 2) AS p2, any_value(ok) FILTER (k = 2) AS ok2 FROM n GROUP BY 1), o AS (SELECT item_id, min(ts) AS opened_at FROM a GROUP BY 1)
SELECT item_id, opened_at, CASE WHEN ok1 THEN p1 WHEN ok2 THEN p2 END AS provider_used, CAST(NOT ok1 AND p2 IS NOT NULL AS INTEGER) AS retry_count, CAST(NOT ok1 AS INTEGER) + CAST(NOT ok1 AND coalesce(NOT ok2, false) AS INTEGER) AS failure_count,
  CASE WHEN ok1 OR ok2 THEN NULL WHEN p2 IS NOT NULL THEN 'ops_review' ELSE 'pending_triage' END AS route
FROM t JOIN o USING (item_id) WHERE opened_at + INTERVAL 24 HOUR < (SELECT max(ts) - INTERVAL 10 MINUTE FROM a)""")
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts on an item of a user and a day; items whose deadline the events do not reach are still open."""
    rows = _at_once(spark, sf_dir).where(F.col("event_type").isin("click", "view", "error"))
    attempts = rows.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("item_id"), F.col("event_id").alias("ord"), "at", F.col("event_type").alias("provider"), (F.col("value") > 20).alias("succeeded"))
    with spans.rocksdb_state(spark):
        out = events.drained(spans.attempt_outcomes(attempts, timedelta(hours=24)), shared_folder(spark))
    return out.withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz")).drop("batch")
