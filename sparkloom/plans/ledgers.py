"""Queries on ledgers of records; events stand for records of verifiers, parts for records on the age of a tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import ledger
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_UNSUPPORTED = ("model-2",)
_RECORDS_SQL = f"""r AS (SELECT user_id % 10 AS repo, event_id, event_id % 3 AS kind, event_type, user_id, CASE WHEN event_id % 25 > 0 THEN CAST(event_id % 25 AS VARCHAR) END AS pr, CASE event_id % 4 WHEN 0 THEN 'needs-human' WHEN 1 THEN 'merged' END AS disposition,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'model-' || user_id % 3 END AS model, CASE WHEN event_id % 5 = 0 THEN 't' || user_id % 7 END AS ref FROM events),
k AS (SELECT *, CASE WHEN kind = 0 THEN CASE WHEN event_id % 2 = 0 AND user_id > 0 THEN 'run:' || user_id || ':attempt:' || CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id % 4 AS VARCHAR) END ELSE coalesce('pr:' || pr, 'entry:' || event_id) END END AS run, coalesce(disposition, event_type) AS shown FROM r),
c AS (SELECT repo, unnest([{{'counter': 'run', 'value': run}}, {{'counter': 'pr', 'value': CASE WHEN kind < 2 THEN pr END}}, {{'counter': 'verdict', 'value': CASE WHEN kind = 0 THEN event_type END}},
  {{'counter': 'terminal_disposition', 'value': CASE WHEN kind = 1 THEN shown END}}, {{'counter': 'terminal_source', 'value': CASE WHEN kind = 1 THEN event_type || ':' || CASE WHEN event_id % 2 = 0 OR user_id = 0 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END END}},
  {{'counter': 'model', 'value': CASE WHEN kind < 2 THEN model END}}, {{'counter': 'unsupported_model', 'value': CASE WHEN kind < 2 AND model = 'model-2' THEN model END}}, {{'counter': 'unsupported_disposition', 'value': CASE WHEN kind < 2 AND model = 'model-2' THEN shown END}},
  {{'counter': 'issues_created', 'value': CASE WHEN kind < 2 THEN CAST(event_id % 3 AS VARCHAR) END}}, {{'counter': 'acceptance', 'value': CASE WHEN kind < 2 AND event_id % 2 = 0 THEN CAST(user_id % 9 AS VARCHAR) END}},
  {{'counter': 'traced_run', 'value': CASE WHEN ref IS NOT NULL THEN run END}}, {{'counter': 'trace_ref', 'value': run || ' id:' || ref}}, {{'counter': 'trace_ref', 'value': CASE WHEN ref IS NOT NULL THEN run || ' url:u' || event_id % 2 END}},
  {{'counter': 'ledger_disposition', 'value': CASE WHEN kind = 2 THEN coalesce(disposition, 'unknown') END}}, {{'counter': 'ledger_pr', 'value': CASE WHEN kind = 2 THEN pr END}}, {{'counter': 'ledger_followup', 'value': CASE WHEN kind = 2 THEN CAST(user_id AS VARCHAR) END}},
  {{'counter': 'ledger_needs_human', 'value': CASE WHEN kind = 2 AND (disposition = 'needs-human' OR event_id % 7 = 0) THEN 'yes' END}}, {{'counter': 'ledger_chain_depth', 'value': CASE WHEN kind = 2 THEN CAST(event_id % 6 AS VARCHAR) END}},
  {{'counter': 'ledger_policy_action', 'value': CASE WHEN kind = 2 AND event_id % 2 = 0 THEN event_type END}}, {{'counter': 'ledger_policy_trigger', 'value': CASE WHEN kind = 2 AND event_id % 2 = 0 THEN 'unknown' END}}, {{'counter': 'ledger_depth_exceeded', 'value': CASE WHEN kind = 2 AND event_id % 8 = 2 THEN 'yes' END}}], recursive := true) FROM k),
n AS (SELECT repo, counter, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY 1, 2, 3)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    form = key % 3
    traced = key % 5 == 0
    fields = F.struct(
        F.when(form == 1, ledger.TERMINAL).when(form == 2, ledger.LEDGER).alias("schema"),
        F.when(form == 0, kind).alias("verdict"),
        F.when(key % 4 == 0, "needs-human").when(key % 4 == 1, "merged").alias("disposition"),
        kind.alias("terminal_state"),
        kind.alias("source_type"),
        F.when(key % 2 > 0, user).alias("source_id"),
        F.when(key % 11 > 0, F.concat(F.lit(" MODEL-"), (user % 3).cast("string"))).alias("llm_model"),
        F.when(key % 2 == 0, user).alias("workflow_run_id"),
        (key % 4).alias("run_attempt"),
        (key % 25).alias("pr"),
        (key % 3).alias("issues_created"),
        F.when(key % 2 == 0, (user % 9).cast("string")).alias("acceptance_criteria_count"),
        F.when(traced, F.concat(F.lit("t"), (user % 7).cast("string"))).alias("langsmith_trace_id"),
        F.when(traced, F.array(F.struct(F.lit("").alias("trace_id"), F.concat(F.lit("u"), (key % 2).cast("string")).alias("langsmith_trace_url")))).alias("langsmith_traces"),
        user.alias("followup_issue_number"),
        (key % 7 == 0).alias("needs_human"),
        (key % 6).alias("chain_depth"),
        F.when(key % 2 == 0, F.struct(kind.alias("action"), (key % 8 == 2).alias("depth_limit_exceeded"))).alias("followup_policy"),
    )
    return table(spark, sf_dir, "events").select((user % 10).alias("repo"), key.alias("ord"), F.to_json(fields).alias("json"))


@query(f"WITH {_RECORDS_SQL} SELECT repo, counter, value, n FROM n")
def verifier_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verifier_counters(_records(spark, sf_dir), "repo", _UNSUPPORTED)


@query(f"""WITH {_RECORDS_SQL}
SELECT repo, count(*) FILTER (counter = 'run') AS runs, count(*) FILTER (counter = 'pr') AS prs, CAST(coalesce(sum(CAST(value AS BIGINT) * n) FILTER (counter = 'issues_created'), 0) AS BIGINT) AS issues_created,
  round(coalesce(sum(CAST(value AS BIGINT) * n) FILTER (counter = 'acceptance') / sum(n) FILTER (counter = 'acceptance'), 0)::DOUBLE, 6) AS avg_acceptance, count(*) FILTER (counter = 'traced_run') AS trace_records, count(*) FILTER (counter = 'trace_ref') AS trace_count,
  CAST(coalesce(sum(n) FILTER (counter = 'terminal_disposition'), 0) AS BIGINT) AS terminal_records, CAST(coalesce(sum(n) FILTER (counter = 'ledger_disposition'), 0) AS BIGINT) AS ledger_records, count(*) FILTER (counter = 'ledger_pr') AS ledger_prs, count(*) FILTER (counter = 'ledger_followup') AS ledger_followup_issues,
  CAST(coalesce(sum(n) FILTER (counter = 'ledger_needs_human'), 0) AS BIGINT) AS ledger_needs_human, round(coalesce(sum(CAST(value AS BIGINT) * n) FILTER (counter = 'ledger_chain_depth') / sum(n) FILTER (counter = 'ledger_chain_depth'), 0)::DOUBLE, 6) AS ledger_avg_chain_depth,
  coalesce(max(CAST(value AS BIGINT)) FILTER (counter = 'ledger_chain_depth'), 0) AS ledger_max_chain_depth, CAST(coalesce(sum(n) FILTER (counter = 'ledger_policy_action'), 0) AS BIGINT) AS ledger_policy_records, CAST(coalesce(sum(n) FILTER (counter = 'ledger_depth_exceeded'), 0) AS BIGINT) AS ledger_depth_exceeded
FROM (SELECT repo, counter, CASE WHEN counter IN ('issues_created', 'acceptance', 'ledger_chain_depth') THEN value END AS value, n FROM n) GROUP BY 1""")
def verifier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verifier_summary(ledger.verifier_counters(_records(spark, sf_dir), "repo", _UNSUPPORTED), "repo")


@query("""WITH p AS (SELECT p_size % 5 AS repo, p_partkey AS k, p_name, p_brand FROM part),
c AS (SELECT repo, unnest([{'counter': 'status', 'value': CASE k % 3 WHEN 0 THEN 'latest-unavailable' WHEN 1 THEN 'unknown' ELSE lower(p_brand) END}, {'counter': 'package', 'value': CASE WHEN k % 4 = 0 THEN 'unknown' ELSE p_name END},
  {'counter': 'pinned', 'value': k % 9 || '.' || k % 7 || '.0-rc1'}, {'counter': 'latest', 'value': CASE WHEN k % 2 = 0 THEN 'next' ELSE 'unknown' END}, {'counter': 'major', 'value': CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE k % 9 END AS VARCHAR)}, {'counter': 'minor', 'value': '0'}, {'counter': 'patch', 'value': '0'},
  {'counter': 'target', 'value': CASE WHEN k % 5 > 0 THEN p_name END}, {'counter': 'target', 'value': CASE WHEN k % 5 > 0 THEN p_name END}], recursive := true) FROM p)
SELECT repo, counter, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def freshness_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    given = key % 5 > 0
    fields = F.struct(
        F.when(key % 3 == 0, "Latest_Unavailable").when(key % 3 == 1, " ").otherwise(F.col("p_brand")).alias("status"),
        F.when(key % 4 > 0, F.concat(F.lit(" "), name)).alias("package"),
        F.concat(F.lit("tool "), F.concat_ws(".", (key % 9).cast("string"), (key % 7).cast("string"), F.lit("0-rc1"))).alias("pinned_version"),
        F.when(key % 2 == 0, "next").alias("latest_version"),
        F.when(given, F.struct((key % 9).alias("major"), F.lit("x").alias("minor"), F.lit(-3).alias("patch"))).alias("version_delta"),
        F.when(given, F.array(F.struct(name.alias("path")), F.struct(name.alias("path")), F.struct(F.lit(" ").alias("path")))).alias("update_targets"),
    )
    return ledger.freshness_counters(table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("repo"), F.to_json(fields).alias("json")), "repo")
