"""Queries that hold nested records to a contract; orders stand for runs, events for fleet records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import contracts, runs
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_TEXT = {"type": "string", "minLength": 1}
_COUNT = {"type": "integer", "minimum": 0}


def _object(required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "required": list(required), "properties": properties}


def _one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def _list(items: dict) -> dict:
    return {"type": "array", "items": items}


#: The run contract's fields, states and patterns.
RUN_SCHEMA = _object(
    ("schema_version", "repo", "tool", "run_id", "status", "actor", "inputs", "outputs", "provenance", "github_issue"),
    schema_version={"const": "run-contract/v1"},
    repo=_TEXT,
    tool=_TEXT,
    run_id=_TEXT,
    status=_one_of("success", "error", "partial", "fallback", "skipped"),
    github_issue=_TEXT,
    actor=_object(("kind", "id"), kind=_one_of("human", "agent", "schedule", "recipe", "ci"), id=_TEXT, intent=_TEXT, correlation_id=_TEXT),
    inputs=_object(("validated",), validated={"type": "boolean"}, refs=_list({"type": "string", "pattern": "^(sha256:|hash:|artifact:|ref:).+"}), summary=_object()),
    outputs=_object(("manifest_ref",), manifest_ref=_TEXT, summary=_object(), artifact_ids=_list(_TEXT)),
    provenance=_object(("tool_version",), tool_version=_TEXT, git_sha={"type": ["string", "null"]}, python_version=_TEXT, platform=_TEXT, code_version=_TEXT),
    cost=_object(usd={"type": ["number", "null"], "minimum": 0}, input_tokens=_COUNT, output_tokens=_COUNT),
    latency=_object(wall_ms={"type": "number", "minimum": 0}, peak_mem_mb={"type": "number", "minimum": 0}),
    warnings=_list(_object(("code", "severity", "message"), code=_TEXT, severity=_one_of("info", "warning", "error"), message=_TEXT, context=_object())),
    data_quality=_object(overall_status=_one_of("ok", "info", "warn", "fail"), dropped_rows=_COUNT, coerced_rows=_COUNT, conflict={"type": "boolean"}, findings=_list(_object())),
    evidence_refs=_list(_TEXT),
    identity_refs=_list({"type": "string", "pattern": "^[a-z0-9_]+:[a-z0-9][a-z0-9_.:-]*$"}),
    recorded_at={"type": "string"},
    parent_run_id=_TEXT,
)


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, repo, json): an envelope of each order, most with one fault."""
    key = F.col("o_orderkey")
    m = key % 13
    fault = lambda n, bad, good: F.when(m == n, F.lit(bad)).otherwise(F.lit(good))
    repo = F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (key % 3 + 1).cast("int"))
    raw = F.struct(F.struct(F.when(m == 4, "x").alias("raw_prompt"), F.lit("").alias("prompt")).alias("deep"))
    envelope = F.struct(
        fault(5, "v0", "run-contract/v1").alias("schema_version"),
        repo.alias("repo"),
        F.lit("tool").alias("tool"),
        fault(9, "", "r").alias("run_id"),
        fault(0, "weird", "success").alias("status"),
        F.lit("#1").alias("github_issue"),
        F.struct(F.lit("agent").alias("kind"), F.when(m != 1, F.col("o_orderpriority")).alias("id")).alias("actor"),
        F.struct(F.lit(True).alias("validated"), F.array(F.lit("sha256:x"), fault(2, "bad", "ref:y")).alias("refs")).alias("inputs"),
        F.struct(F.lit("m").alias("manifest_ref"), F.array(F.lit("a1"), fault(8, "zz", "a2")).alias("artifact_ids")).alias("outputs"),
        F.struct(F.lit("1").alias("tool_version")).alias("provenance"),
        F.when(m != 10, F.struct(F.when(m == 3, -1.0).otherwise(F.col("o_totalprice")).alias("usd"))).alias("cost"),
        F.struct(fault(6, "fast", "12").alias("wall_ms")).alias("latency"),
        F.array(F.struct(F.lit("w").alias("code"), fault(4, "loud", "info").alias("severity"), F.lit("odd").alias("message"), raw.alias("context"))).alias("warnings"),
        F.array(fault(7, "BAD", "fund:1")).alias("identity_refs"),
    )
    json = F.replace(F.to_json(envelope), F.lit('"wall_ms":"12"'), F.lit('"wall_ms":12'))
    return table(spark, sf_dir, "orders").select(key.alias("run_id"), repo.alias("repo"), F.when(m == 11, F.left(json, F.lit(99))).otherwise(json).alias("json"))


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 13 AS m, o_orderkey % 3 AS repo FROM orders WHERE o_orderkey % 3 <> 1)
SELECT run_id, path, rule, detail FROM r JOIN (VALUES (0, 'status', 'enum', 'weird'), (1, 'actor', 'required', 'id'), (2, 'inputs.refs[1]', 'pattern', 'bad'), (3, 'cost.usd', 'minimum', NULL),
  (4, 'warnings[0].severity', 'enum', 'loud'), (4, 'warnings[0].context.deep.raw_prompt', 'raw_payload', 'raw_prompt'), (5, 'schema_version', 'const', 'v0'), (6, 'latency.wall_ms', 'type', 'string'),
  (7, 'identity_refs[0]', 'pattern', 'BAD'), (7, 'identity_refs[0]', 'identity', 'BAD'), (8, 'outputs.artifact_ids[1]', 'not_in_manifest', 'zz'), (9, 'run_id', 'minLength', ''), (11, '', 'json', 'broken')) f(m, path, rule, detail) USING (m)
UNION ALL SELECT run_id, s, 'section_absent', s FROM r, (VALUES ('cost'), ('warnings')) t(s) WHERE repo = 2 AND (m = 11 OR m = 10 AND s = 'cost')
UNION ALL SELECT run_id, 'outputs.artifact_ids[1]', 'no_hash_in_manifest', 'a2' FROM r WHERE run_id % 4 = 0 AND m NOT IN (8, 11)""")
def run_contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beta is only a candidate, so nothing is asked of it; gamma has to report cost and warnings."""
    participants = spark.createDataFrame([("alpha", "emitting"), ("beta", "candidate"), ("gamma", "conformant")], "repo string, status string")
    required = spark.createDataFrame([("gamma", "cost"), ("gamma", "warnings")], "repo string, section string")
    records = run_records(spark, sf_dir)
    hash_ = F.when((F.col("run_id") % 4 == 0) & (F.col("artifact_id") == "a2"), "").otherwise(F.sha2("artifact_id", 256))
    manifests = records.select("run_id", F.explode(F.array(F.lit("a1"), F.lit("a2"))).alias("artifact_id")).withColumn("sha256", hash_)
    return contracts.contract_issues(records, "run_id", RUN_SCHEMA, participants, required, manifests)


@query("""SELECT event_id AS record_id, 'domain.items[1].Raw_Text' AS path, 'sensitive_field' AS rule, 'Raw_Text' AS detail FROM events WHERE event_id % 30 = 7
UNION ALL SELECT event_id, 'props.' || event_type || '_secret_id', 'sensitive_field', event_type || '_secret_id' FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) % 10 = 3""")
def fleet_sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive names at any depth of a record made of an event and its own properties."""
    key, kind = F.col("event_id"), F.col("event_type")
    items = F.array(F.create_map(F.lit("k"), kind), F.create_map(F.when(key % 30 == 7, "Raw_Text").otherwise("note"), kind))
    name = F.when(F.get_json_object("props", "$.k").cast("int") % 10 == 3, F.concat(kind, F.lit("_secret_id"))).otherwise("k")
    json = F.to_json(F.struct(F.struct(items.alias("items")).alias("domain"), F.create_map(name, F.col("props")).alias("props")))
    records = table(spark, sf_dir, "events").select(key.alias("record_id"), json.alias("json"))
    return contracts.sensitive_fields(contracts.values(records, "record_id"), "record_id", runs.SENSITIVE_TOKENS)
