"""Queues, lifecycles, service deadlines, spans, corrections and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.dates import same_day_due
from sparkloom.functions.strings import zero_safe_ratio

# The moves that each lifecycle allows, and what is to be done in a queue state.
INGEST_MOVES = {"": ("received",), "received": ("processing", "escalated"), "processing": ("completed", "escalated")}
QUEUE_MOVES = {
    "": ("pending_triage",),
    "pending_triage": ("in_validation",),
    "in_validation": ("awaiting_manager_response", "ops_review", "completed", "rejected"),
    "awaiting_manager_response": ("in_validation", "ops_review", "rejected"),
    "ops_review": ("in_validation", "completed", "rejected"),
}
NEXT_ACTION = {
    "pending_triage": "Claim by analyst",
    "in_validation": "Review extracted fields",
    "awaiting_manager_response": "Collect manager clarification",
    "ops_review": "Ops policy decision",
    "completed": "No action",
    "rejected": "No further action",
}


def next_action(state: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NEXT_ACTION.items() for x in kv]), state), F.lit("No action"))


def queue_page(rows: DataFrame, condition: Column | None = None, sort_by: str = "updated_at", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the filtered queue; the item id breaks ties in the same direction. A page is the feature, of 1 to 500 rows."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    kept = rows if condition is None else rows.where(condition)
    keys = [F.coalesce(sort_by, F.lit("")) if sort_by == "owner_id" else F.col(sort_by), F.col("item_id")]
    return kept.orderBy(*[k.desc() if descending else k.asc() for k in keys]).offset(offset).limit(limit)


def lifecycle(events: DataFrame, moves: dict[str, tuple[str, ...]]) -> DataFrame:
    """The last lawful state of every item of events(item_id, at, ord, to_state), and how many moves were not allowed.

    Events are folded in order of (at, ord); staying in a state is no move. An item has few events.
    """
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in moves.items() for b in bs])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("moves"), F.lit(0).alias("illegal"))

    def step(s: Column, e: Column) -> Column:
        same = s["state"] == e["to_state"]
        fits = F.array_contains(allowed, F.concat(s["state"], F.lit(">"), e["to_state"]))
        return F.struct(
            F.when(fits, e["to_state"]).otherwise(s["state"]).alias("state"),
            (s["moves"] + F.when(fits & ~same, 1).otherwise(0)).alias("moves"),
            (s["illegal"] + F.when(~fits & ~same, 1).otherwise(0)).alias("illegal"),
        )

    folded = events.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "ord", "to_state"))).alias("e"))
    return folded.select("item_id", F.aggregate("e", start, step).alias("s")).select("item_id", "s.state", "s.moves", "s.illegal")


def sla_breaches(events: DataFrame) -> DataFrame:
    """Due time of each item, the end of the day it began, and the first event after it; breach stays."""
    begun = events.groupBy("item_id").agg(F.min("at").alias("created_at"))
    due = begun.withColumn("due_at", same_day_due(F.col("created_at")))
    late = events.join(due, "item_id").where(F.col("at") > F.col("due_at")).groupBy("item_id").agg(F.min("at").alias("breached_at"))
    return due.join(late, "item_id", "left").withColumn("breached", F.col("breached_at").isNotNull())


def span_durations(events: DataFrame) -> DataFrame:
    """Starts and ends of one span key paired in order: events(span, kind start or end, at, ord).

    Each end is paired with the oldest open start; an end without one is ignored. The number of
    ends that count is found from the running balance: an end is an orphan when the balance of
    starts less ends reaches a new low.
    """
    w = Window.partitionBy("span").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("span").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, -1)
    balance = events.withColumn("balance", F.sum(F.when(F.col("kind") == "start", 1).otherwise(-1)).over(w))
    lowest = F.coalesce(F.least(F.min("balance").over(before), F.lit(0)), F.lit(0))
    kept = balance.withColumn("orphan", (F.col("kind") == "end") & (F.col("balance") < lowest)).where("not orphan")
    numbered = kept.withColumn("n", F.row_number().over(Window.partitionBy("span", "kind").orderBy("at", "ord")))
    starts = numbered.where("kind = 'start'").select("span", "n", F.col("at").alias("started_at"))
    ends = numbered.where("kind = 'end'").select("span", "n", F.col("at").alias("ended_at"))
    paired = starts.join(ends, ["span", "n"])
    return paired.select("span", "n", "started_at", "ended_at", (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))).alias("micros"))


def latest_values(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """The newest correction of each field, by (corrected_at, correction_id), else its own value."""
    newest = corrections.groupBy("field_id").agg(F.max(F.struct("corrected_at", "correction_id", "corrected_value")).alias("c"), F.count("*").alias("corrections"))
    joined = fields.join(newest, "field_id", "left")
    return joined.select("field_id", F.coalesce("c.corrected_value", "value").alias("value"), F.col("c").isNotNull().alias("corrected"), F.coalesce("corrections", F.lit(0)).cast("bigint").alias("corrections"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last record of each (artifact_id, reviewer) by (reviewed_at, ord)."""
    w = Window.partitionBy("artifact_id", "reviewer").orderBy(F.col("reviewed_at").desc(), F.col("ord").desc())
    return feedback.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Counts, rate, mean rank, histogram of ranks and disagreement for each artifact, of the latest records."""
    ranks = [F.count_if(F.col("quality_rank") == k).alias(f"rank_{k}") for k in range(1, 6)]
    out = latest_feedback(feedback).groupBy("artifact_id").agg(
        F.count("*").alias("reviews"),
        F.count_if("is_informative").alias("informative"),
        F.avg("quality_rank").alias("mean_rank"),
        *ranks,
        F.min("reviewed_at").alias("first_at"),
        F.max("reviewed_at").alias("last_at"),
        (F.max("quality_rank") - F.min("quality_rank")).alias("range"),
        (F.min(F.col("is_informative").cast("int")) != F.max(F.col("is_informative").cast("int"))).alias("differ"),
    )
    disagree = (F.col("reviews") > 1) & (F.col("differ") | (F.col("range") >= 2))
    return out.withColumns({"informative_rate": zero_safe_ratio(F.col("informative"), F.col("reviews")), "mean_rank": F.round("mean_rank", 4), "disagreement": disagree}).drop("range", "differ")


def cross_check_items(reports: DataFrame) -> DataFrame:
    """A queue item for each of reports(entity, escalate, reasons) that escalates."""
    package = F.col("entity").cast("string")
    return reports.where("escalate").select(F.concat(package, F.lit(":validation:extraction_cross_check")).alias("item_id"), package.alias("package_id"), F.lit("pending_triage").alias("state"), F.col("reasons").alias("escalation_reason"))
