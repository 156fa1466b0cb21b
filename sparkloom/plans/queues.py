"""Queries over queue items, assignments, review windows and audits; events stand for what actors do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import queues, workflow
from sparkloom.plans.registry import query
from sparkloom.plans.workflow import _FEEDBACK_SQL, feedback
from sparkloom.sources.tables import table


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


_TARGETS = ("in_validation", "awaiting_manager_response", "ops_review", "completed", "in_validation", "rejected", "ops_review")
_ACTIONS_SQL = f"""q AS (SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 5 = 0 THEN 'claim' WHEN event_id % 5 = 1 THEN 'transfer' ELSE 'move' END AS action, 'a' || (event_id % 2) AS actor,
  CASE WHEN event_id % 3 = 0 THEN 'ops' ELSE 'analyst' END AS role, CASE event_id % 7 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_TARGETS))} END AS to_state, CASE WHEN event_id % 4 > 0 THEN 'a' || ((event_id + 1) % 2) ELSE '' END AS new_owner FROM events)"""
_MOVES_SQL = " OR ".join(f"(state = '{a}' AND to_state = '{b}')" for a, bs in workflow.QUEUE_MOVES.items() if a for b in bs)


@query(f"""WITH RECURSIVE {_ACTIONS_SQL}, fold AS (SELECT item_id, 0::BIGINT AS n, 'pending_triage' AS state, NULL::VARCHAR AS owner_id, NULL::VARCHAR AS owner_role, 0 AS applied, 0 AS rejected FROM (SELECT DISTINCT item_id FROM q)
UNION ALL SELECT item_id, n, CASE WHEN claims THEN 'in_validation' WHEN moves THEN to_state ELSE state END, CASE WHEN claims THEN actor WHEN gives THEN new_owner ELSE owner_id END, CASE WHEN claims THEN 'analyst' WHEN gives THEN role ELSE owner_role END,
  applied + CAST(claims OR gives OR moves AS INTEGER), rejected + CAST(NOT (claims OR gives OR moves OR (action = 'move' AND state = to_state)) AS INTEGER)
FROM (SELECT q.*, f.state, f.owner_id, f.owner_role, f.applied, f.rejected, action = 'claim' AND owner_id IS NULL AND state = 'pending_triage' AS claims,
    coalesce(action = 'transfer' AND owner_id IS NOT NULL AND (owner_id = actor OR role = 'ops') AND state NOT IN ('completed', 'rejected') AND new_owner <> '', false) AS gives,
    coalesce(action = 'move' AND owner_id IS NOT NULL AND (owner_id = actor OR role = 'ops') AND ({_MOVES_SQL}), false) AS moves FROM fold f JOIN q ON q.item_id = f.item_id AND q.n = f.n + 1))
SELECT item_id, arg_max(state, n) AS state, max_by(owner_id, n) AS owner_id, max_by(owner_role, n) AS owner_role, max(applied) AS applied, max(rejected) AS rejected FROM (SELECT item_id, n, state, coalesce(owner_id, '') AS owner_id, coalesce(owner_role, '') AS owner_role, applied, rejected FROM fold) GROUP BY 1""")
def queue_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    role = F.when(key % 3 == 0, "ops").otherwise("analyst")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"),
        F.struct("ts", "event_id").alias("ord"),
        F.when(key % 5 == 0, "claim").when(key % 5 == 1, "transfer").otherwise("move").alias("action"),
        F.concat(F.lit("a"), (key % 2).cast("string")).alias("actor_id"),
        role.alias("actor_role"),
        _pick(_TARGETS, key % 7).alias("to_state"),
        F.when(key % 4 > 0, F.concat(F.lit("a"), ((key + 1) % 2).cast("string"))).otherwise("").alias("new_owner"),
        role.alias("new_role"),
    )
    return queues.queue_fold(events).withColumns({c: F.coalesce(c, F.lit("")) for c in ("owner_id", "owner_role")})


@query("""SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey % 4 IN (0, 2) AND o_orderkey % 2 = 0 AND contains(lower(o_orderpriority || ' Low_Coverage'), 'high low') = false AND contains(lower('Low_' || o_orderpriority), 'low_1-u') AND o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' AND o_orderdate <= TIMESTAMP '1999-01-01 00:00:00'""")
def queue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("item_id"),
        _pick(("pending_triage", "in_validation", "ops_review", "completed"), key % 4).alias("state"),
        F.when(key % 2 == 0, "ops").otherwise("analyst").alias("owner_role"),
        F.concat(F.lit("Low_"), "o_orderpriority").alias("escalation_reason"),
        F.col("o_orderdate").alias("updated_at"),
    )
    given = {"state": "pending_triage, ops_review", "owner_role": "ops", "escalation_contains": "LOW_1-u", "updated_after": "1995-06-01T00:00:00", "updated_before": "1999-01-01T00:00:00Z"}
    wanted = queues.queue_parameters(given)
    names = ("states", "owner_roles", "owner_id", "package_id", "reason_contains", "updated_after", "updated_before")
    return rows.where(queues.queue_condition(**{k: wanted[k] for k in names})).select("item_id")


_ASSIGN_SQL = """q AS (SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts AS tm, CASE WHEN event_id % 4 = 0 THEN 'reassign' ELSE 'observe' END AS action, 'a' || (event_id % 2) AS actor, CASE WHEN event_id % 3 > 0 THEN 'ops1' END AS ops FROM events)"""


@query(f"""WITH RECURSIVE {_ASSIGN_SQL}, fold AS (SELECT item_id, n, actor AS owner_id, 'analyst' AS owner_role, tm AS assigned_at, date_trunc('day', tm) + INTERVAL '23 hours 59 minutes 59 seconds' AS due_at, NULL::TIMESTAMP AS breached_at FROM q WHERE n = 1
UNION ALL SELECT item_id, n, CASE WHEN gives THEN ops ELSE owner_id END, CASE WHEN gives THEN 'ops' ELSE owner_role END, CASE WHEN gives THEN tm ELSE assigned_at END, CASE WHEN gives THEN date_trunc('day', tm) + INTERVAL '23 hours 59 minutes 59 seconds' ELSE due_at END,
  CASE WHEN action = 'observe' AND breached_at IS NULL AND tm > due_at THEN tm ELSE breached_at END FROM (SELECT q.*, f.owner_id, f.owner_role, f.assigned_at, f.due_at, f.breached_at, action = 'reassign' AND owner_role = 'analyst' AND actor = owner_id AND ops IS NOT NULL AS gives FROM fold f JOIN q ON q.item_id = f.item_id AND q.n = f.n + 1))
SELECT item_id, owner_id, owner_role, assigned_at, due_at, breached_at FROM fold QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC) = 1""")
def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.col("ts").alias("at"), key.alias("ord"), F.when(key % 4 == 0, "reassign").otherwise("observe").alias("action"), F.concat(F.lit("a"), (key % 2).cast("string")).alias("actor_id"), F.when(key % 3 > 0, "ops1").alias("ops_id")
    )
    return queues.assignments(events)


@query("""WITH e AS (SELECT user_id AS item_id, ts AS tm, event_id AS ord, event_type AS reason, CASE event_id % 3 WHEN 0 THEN 'c' || event_id WHEN 1 THEN ' ' END AS own, 'tag' || event_id AS tag FROM events WHERE event_id % 4 = 3)
SELECT item_id, min(tm) AS escalated_at, arg_min(reason, (tm, ord)) AS reason, arg_min(coalesce(nullif(trim(own), ''), tag), (tm, ord)) AS correlation_id FROM e GROUP BY 1""")
def escalation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"),
        F.col("ts").alias("at"),
        key.alias("ord"),
        F.when(key % 4 == 3, "escalated").otherwise("processing").alias("to_state"),
        F.col("event_type").alias("reason"),
        F.when(key % 3 == 0, F.concat(F.lit("c"), key.cast("string"))).when(key % 3 == 1, " ").alias("correlation_id"),
        F.create_map(F.lit("correlation_id"), F.concat(F.lit("tag"), key.cast("string"))).alias("tags"),
    )
    return queues.escalation_payloads(events)


@query(f"WITH {_FEEDBACK_SQL} SELECT artifact_id, reviewer, ord FROM fb WHERE reviewed_at BETWEEN (SELECT max(ts) FROM events) - INTERVAL 24 HOURS AND (SELECT max(ts) FROM events)")
def review_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feedback(spark, sf_dir)
    last = rows.agg(F.max("reviewed_at")).head()[0]
    return queues.review_window(rows, F.lit(last)).select("artifact_id", "reviewer", "ord")


@query(f"WITH {_FEEDBACK_SQL} SELECT ord FROM fb WHERE reviewed_at >= (SELECT min(date_trunc('day', ts)) FROM events) + INTERVAL 26 HOURS AND reviewed_at <= (SELECT min(date_trunc('day', ts)) FROM events) + INTERVAL 99 HOURS")
def feedback_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    rows = feedback(spark, sf_dir)
    day = rows.agg(F.min(F.date_trunc("day", "reviewed_at"))).head()[0].replace(tzinfo=datetime.UTC)
    at = lambda hours, zone: (day + datetime.timedelta(hours=hours)).astimezone(zone).isoformat()
    return queues.feedback_range(rows, at(26, datetime.timezone(datetime.timedelta(hours=2))), at(99, datetime.UTC).replace("+00:00", "Z")).select("ord")


@query("""SELECT user_id AS item_id, event_id AS ord, 'evt_' || left(sha1(user_id || '|' || event_id || '|' || event_type), 16) AS event_id, strftime(CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 2 HOURS ELSE ts END, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, event_type AS actor, 'a=' || (event_id % 3) || ';b=x' AS details FROM events""")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    at = F.when(key % 2 == 0, F.concat(text, F.lit("+02:00"))).otherwise(text)
    details = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), (key % 3).cast("string"))
    return queues.audit_records(table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), key.alias("ord"), at.alias("at"), F.col("event_type").alias("actor"), details.alias("details")))
