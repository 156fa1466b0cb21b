"""Queue items as folds of their events, queue filters, assignments, review windows and audit records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.dates import same_day_due, utc_timestamp
from sparkloom.operators.workflow import NEXT_ACTION, QUEUE_MOVES

TERMINAL = ("completed", "rejected")
ROLES = ("analyst", "ops")
SORTS = ("updated_at", "state", "owner_id")


def queue_fold(events: DataFrame) -> DataFrame:
    """The state and owner of every item of events(item_id, ord, action, actor_id, actor_role, to_state, new_owner, new_role).

    An item begins unowned in pending_triage. claim takes it for the actor, an analyst; transfer
    gives it to another owner, by its owner or ops, unless it has ended; move changes the state by
    the allowed moves, by its owner or ops. A move to the same state is nothing; all else is
    rejected and counted. An item has few events.
    """
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in QUEUE_MOVES.items() if a for b in bs])
    start = F.struct(F.lit("pending_triage").alias("state"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("role"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))

    def step(s: Column, e: Column) -> Column:
        named = F.coalesce(e["actor_id"], F.lit("")) != ""
        may = s["owner"].isNotNull() & named & ((s["owner"] == e["actor_id"]) | (e["actor_role"] == "ops"))
        claims = (e["action"] == "claim") & s["owner"].isNull() & (s["state"] == "pending_triage") & named
        gives = (e["action"] == "transfer") & may & ~s["state"].isin(*TERMINAL) & (F.coalesce(e["new_owner"], F.lit("")) != "")
        same = (e["action"] == "move") & (s["state"] == e["to_state"])
        moves = (e["action"] == "move") & ~same & may & F.array_contains(allowed, F.concat(s["state"], F.lit(">"), e["to_state"]))
        claims, gives, same, moves = (F.coalesce(x, F.lit(False)) for x in (claims, gives, same, moves))
        done = claims | gives | moves
        return F.struct(
            F.when(claims, "in_validation").when(moves, e["to_state"]).otherwise(s["state"]).alias("state"),
            F.when(claims, e["actor_id"]).when(gives, e["new_owner"]).otherwise(s["owner"]).alias("owner"),
            F.when(claims, "analyst").when(gives, e["new_role"]).otherwise(s["role"]).alias("role"),
            (s["applied"] + done.cast("int")).alias("applied"),
            (s["rejected"] + (~done & ~same).cast("int")).alias("rejected"),
        )

    item = F.struct("ord", "action", "actor_id", "actor_role", "to_state", "new_owner", "new_role")
    folded = events.groupBy("item_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    return folded.select("item_id", F.aggregate("e", start, step).alias("s")).select("item_id", "s.state", F.col("s.owner").alias("owner_id"), F.col("s.role").alias("owner_role"), "s.applied", "s.rejected")


def queue_condition(states: tuple = (), owner_roles: tuple = (), owner_id: str | None = None, package_id: str | None = None, reason_contains: str | None = None, updated_after: str | None = None, updated_before: str | None = None) -> Column:
    """A filter of queue rows; an empty tuple or None is no filter, times are inclusive, the reason is searched in any case."""
    out = F.lit(True)
    for values, name in ((states, "state"), (owner_roles, "owner_role")):
        out = out & F.col(name).isin(*values) if values else out
    for value, name in ((owner_id, "owner_id"), (package_id, "package_id")):
        out = out & (F.col(name) == value) if value is not None else out
    if reason_contains is not None:
        out = out & F.contains(F.lower("escalation_reason"), F.lit(reason_contains.casefold()))
    at = F.col("updated_at").cast("timestamp")
    if updated_after is not None:
        out = out & (at >= utc_timestamp(F.lit(updated_after)))
    if updated_before is not None:
        out = out & (at <= utc_timestamp(F.lit(updated_before)))
    return out


def queue_parameters(given: Mapping[str, str]) -> dict[str, object]:
    """Checked parameters of a queue page from text: lists by comma, trimmed; ValueError for what is not allowed."""
    items = lambda key: tuple(x.strip() for x in given.get(key, "").split(",") if x.strip())
    plain = lambda key: given.get(key, "").strip() or None
    out: dict[str, object] = {"states": items("state"), "owner_roles": items("owner_role")}
    for values, domain, name in ((out["states"], NEXT_ACTION, "state"), (out["owner_roles"], ROLES, "owner_role")):
        if set(values) - set(domain):
            raise ValueError(f"unknown {name}: {', '.join(sorted(set(values) - set(domain)))}")
    out |= {"owner_id": plain("owner_id"), "package_id": plain("package_id"), "reason_contains": plain("escalation_contains"), "updated_after": plain("updated_after"), "updated_before": plain("updated_before")}
    for name, default in (("limit", 50), ("offset", 0)):
        try:
            out[name] = int(given.get(name, default))
        except ValueError:
            raise ValueError(f"{name} must be an integer") from None
    out["sort_by"], direction = given.get("sort_by", "updated_at"), given.get("sort_direction", "desc")
    if out["sort_by"] not in SORTS or direction not in ("asc", "desc"):
        raise ValueError("unknown sort")
    if not 1 <= out["limit"] <= 500 or out["offset"] < 0:
        raise ValueError("limit must be from 1 to 500 and offset not negative")
    return out | {"descending": direction == "desc"}


def assignments(events: DataFrame) -> DataFrame:
    """Owner and deadline of every item of events(item_id, at, ord, action, actor_id, ops_id).

    The first event assigns the item to its actor, an analyst. reassign, by that analyst and once,
    gives it to ops and sets the deadline anew; observe marks a breach if the time is past the
    deadline then in force, the first such time stays. Deadlines are the end of the day.
    """
    start = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("owner", "string"), ("role", "string"), ("assigned", "timestamp_ntz"), ("due", "timestamp_ntz"), ("breached", "timestamp_ntz"))])

    def step(s: Column, e: Column) -> Column:
        first = s["owner"].isNull()
        gives = F.coalesce(~first & (e["action"] == "reassign") & (s["role"] == "analyst") & (e["actor_id"] == s["owner"]) & e["ops_id"].isNotNull(), F.lit(False))
        late = F.coalesce(~first & (e["action"] == "observe") & s["breached"].isNull() & (e["at"] > s["due"]), F.lit(False))
        return F.struct(
            F.when(first, e["actor_id"]).when(gives, e["ops_id"]).otherwise(s["owner"]).alias("owner"),
            F.when(first, "analyst").when(gives, "ops").otherwise(s["role"]).alias("role"),
            F.when(first | gives, e["at"]).otherwise(s["assigned"]).alias("assigned"),
            F.when(first | gives, same_day_due(e["at"]).cast("timestamp_ntz")).otherwise(s["due"]).alias("due"),
            F.when(late, e["at"]).otherwise(s["breached"]).alias("breached"),
        )

    folded = events.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "ord", "action", "actor_id", "ops_id"))).alias("e"))
    out = folded.select("item_id", F.aggregate("e", start, step).alias("s"))
    return out.select("item_id", F.col("s.owner").alias("owner_id"), F.col("s.role").alias("owner_role"), F.col("s.assigned").alias("assigned_at"), F.col("s.due").alias("due_at"), F.col("s.breached").alias("breached_at"))


def escalation_payloads(events: DataFrame) -> DataFrame:
    """The payload of the first escalation of each item of events(item_id, at, ord, to_state, reason, correlation_id, tags map); the event's own correlation id counts before that of its tags."""
    own = F.nullif(F.trim("correlation_id"), F.lit(""))
    found = F.struct("at", "ord", "reason", F.coalesce(own, F.try_element_at("tags", F.lit("correlation_id"))).alias("correlation_id"))
    first = events.where("to_state = 'escalated'").groupBy("item_id").agg(F.min(found).alias("x"))
    return first.select("item_id", F.col("x.at").alias("escalated_at"), "x.reason", "x.correlation_id")


def review_window(feedback: DataFrame, end: Column, hours: int = 24) -> DataFrame:
    """The feedback of the hours that end at a time, both ends included."""
    return feedback.where(F.col("reviewed_at").between(end - F.make_dt_interval(hours=F.lit(hours)), end))


def feedback_range(feedback: DataFrame, reviewed_from: str | None, reviewed_to: str | None) -> DataFrame:
    """The feedback between two times with a zone, both included; None is open, ValueError for a time without a zone."""
    out = feedback
    for value, keep in ((reviewed_from, lambda c, b: c >= b), (reviewed_to, lambda c, b: c <= b)):
        if value is not None:
            if not (value.endswith("Z") or value[-6:-5] in ("+", "-")):
                raise ValueError("a bound must have a time zone")
            out = out.where(keep(F.col("reviewed_at").cast("timestamp"), utc_timestamp(F.lit(value), False)))
    return out


def audit_records(events: DataFrame) -> DataFrame:
    """Audit records of events(item_id, at text, ord, actor, details map): an id from content, UTC seconds, details as text by key."""
    at = F.date_format(utc_timestamp(F.col("at")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    at = F.regexp_replace(at, "Z$", "+00:00")
    details = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    key = F.concat_ws("|", F.col("item_id").cast("string"), F.col("ord").cast("string"), "actor")
    return events.select("item_id", "ord", F.concat(F.lit("evt_"), F.left(F.sha1(key.cast("binary")), F.lit(16))).alias("event_id"), at.alias("at"), "actor", details.alias("details"))
