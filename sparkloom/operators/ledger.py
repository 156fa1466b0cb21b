"""Summaries with many counters from one shuffle: a record becomes a row for each counter it adds to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of record schemas, modes that mean none, models that are no longer served.
TERMINAL = "workflows-terminal-disposition/v1"
LEDGER = "workflows-verifier-followup-ledger/v1"
FIELDS = "schema string, verdict string, disposition string, terminal_state string, source_type string, source_id string, codex_model string, llm_model string, model string, codex_model_selection_reason string, model_selection_reason string, run_id string, workflow_run_id string, run_attempt string, pr_number string, pr string, issues_created string, acceptance_criteria_count string, langsmith_trace_id string, langsmith_trace_url string, langsmith_traces array<struct<trace_id:string,langsmith_trace_id:string,trace_url:string,langsmith_trace_url:string>>, followup_issue_number string, needs_human string, chain_depth string, followup_policy struct<action:string,trigger:string,depth_limit_exceeded:string>"
FRESHNESS = "status string, package string, pinned_version string, latest_version string, version_delta struct<major:string,minor:string,patch:string>, update_targets array<struct<path:string>>"
VERSION = r"(\d+\.\d+\.\d+(?:[-+][A-Za-z0-9._-]+)?)"


def _given(*names: str) -> Column:
    """The first of some fields that is not empty, 0 or false."""
    return F.coalesce(*[F.when(~F.col(f"r.{n}").isin("", "0", "false"), F.col(f"r.{n}")) for n in names])


def _whole(value: Column) -> Column:
    return F.trim(value).try_cast("bigint")


def _counted(rows: DataFrame, by: str, counters: dict[str, Column]) -> DataFrame:
    """(by, counter, value, n): each counter is a text of a row or, if its name ends with [], an array of texts; null adds nothing."""
    texts = lambda c, name: F.transform(F.array_compact(c), lambda v: F.struct(F.lit(name).alias("counter"), v.alias("value")))
    none = F.array().cast("array<string>")
    every = F.concat(*[texts(F.coalesce(c, none) if k.endswith("[]") else F.array(c), k.removesuffix("[]")) for k, c in counters.items()])
    return rows.select(by, F.inline(every)).groupBy(by, "counter", "value").agg(F.count("*").alias("n"))


def verifier_counters(records: DataFrame, by: str, unsupported: tuple[str, ...] = ()) -> DataFrame:
    """(by, counter, value, n) of records(by, ord, json) of verifiers, of terminal dispositions, and of the ledger of follow-ups.

    The run of a record is its run id and attempt, else its pull request, else itself; terminal dispositions have
    none, and ledger rows add to the ledger only. Text that is no JSON object, or null, is a record without fields.
    Numbers and flags are read as they are written, so 0 and false count as not given also as texts.
    """
    rows = records.select(by, "ord", F.coalesce(F.from_json("json", FIELDS), F.from_json(F.lit("{}"), FIELDS)).alias("r"))
    ledger = F.coalesce(F.col("r.schema") == LEDGER, F.lit(False))
    terminal = F.coalesce(F.col("r.schema") == TERMINAL, F.lit(False))
    verifier = lambda c: F.when(~ledger, c)
    entry = lambda c: F.when(ledger, c)
    pull = _whole(_given("pr_number", "pr")).cast("string")
    run = F.when(_given("run_id", "workflow_run_id").isNotNull(), F.concat(F.lit("run:"), _given("run_id", "workflow_run_id"), F.lit(":attempt:"), F.coalesce(_given("run_attempt"), F.lit(""))))
    run = F.when(~ledger & ~terminal, F.coalesce(run, F.concat(F.lit("pr:"), pull), F.concat(F.lit("entry:"), F.col("ord").cast("string"))))
    model = F.nullif(F.lower(F.trim(_given("codex_model", "llm_model", "model"))), F.lit(""))
    disposition = F.coalesce(_given("disposition", "terminal_state"), F.lit("unknown"))
    ref = lambda i, u: F.coalesce(F.concat(F.lit("id:"), F.nullif(F.trim(i), F.lit(""))), F.concat(F.lit("url:"), F.nullif(F.trim(u), F.lit(""))))
    either = lambda t, name: F.coalesce(F.nullif(t[name], F.lit("")), t[f"langsmith_{name}"])
    listed = F.transform("r.langsmith_traces", lambda t: ref(either(t, "trace_id"), either(t, "trace_url")))
    refs = F.concat(F.array(ref(F.col("r.langsmith_trace_id"), F.col("r.langsmith_trace_url"))), F.coalesce(listed, F.array().cast("array<string>")))
    refs = F.array_compact(refs)
    asked = F.coalesce(_given("disposition"), F.lit("unknown"))
    policy = F.col("r.followup_policy")
    human = _given("needs_human").isNotNull() | (asked == "needs-human")
    known = F.array(*[F.lit(m) for m in unsupported]).cast("array<string>")
    return _counted(
        rows,
        by,
        {
            "run": run,
            "pr": verifier(pull),
            "verdict": verifier(_given("verdict")),
            "terminal_disposition": F.when(terminal, disposition),
            "terminal_source": F.when(terminal, F.concat_ws(":", F.coalesce(_given("source_type"), F.lit("unknown")), F.coalesce(_given("source_id"), F.lit("unknown")))),
            "model": verifier(model),
            "unsupported_model": verifier(F.when(F.array_contains(known, model), model)),
            "unsupported_disposition": verifier(F.when(F.array_contains(known, model), disposition)),
            "model_reason": verifier(_given("codex_model_selection_reason", "model_selection_reason")),
            "issues_created": verifier(_whole(F.col("r.issues_created")).cast("string")),
            "acceptance": verifier(_whole(F.col("r.acceptance_criteria_count")).cast("string")),
            "traced_run": F.when(F.size(refs) > 0, run),
            "trace_ref[]": F.when(run.isNotNull(), F.transform(refs, lambda x: F.concat(run, F.lit(" "), x))),
            "ledger_disposition": entry(asked),
            "ledger_pr": entry(pull),
            "ledger_followup": entry(_whole(F.col("r.followup_issue_number")).cast("string")),
            "ledger_needs_human": entry(F.when(human, "yes")),
            "ledger_chain_depth": entry(_whole(F.col("r.chain_depth")).cast("string")),
            "ledger_policy_action": entry(F.when(policy.isNotNull(), F.coalesce(F.nullif(policy["action"], F.lit("")), F.lit("unknown")))),
            "ledger_policy_trigger": entry(F.when(policy.isNotNull(), F.coalesce(F.nullif(policy["trigger"], F.lit("")), F.lit("unknown")))),
            "ledger_depth_exceeded": entry(F.when(F.lower(policy["depth_limit_exceeded"]).isin("true", "1"), "yes")),
        },
    )


def verifier_summary(counted: DataFrame, by: str) -> DataFrame:
    """One row for each group of verifier_counters' rows: distinct runs, pulls, traces and follow-ups; sums and means.

    The counters hold each value once with its number, so this adds up rows of a summary, not of the records.
    """
    is_ = lambda name: F.col("counter") == name
    distinct = lambda name: F.count_if(is_(name))
    total = lambda name: F.coalesce(F.sum(F.when(is_(name), F.col("n"))), F.lit(0))
    number = F.col("value").try_cast("bigint")
    added = lambda name: F.coalesce(F.sum(F.when(is_(name), number * F.col("n"))), F.lit(0))
    mean = lambda name: F.round(F.coalesce(F.try_divide(added(name), total(name)), F.lit(0.0)), 6)
    return counted.groupBy(by).agg(
        distinct("run").alias("runs"),
        distinct("pr").alias("prs"),
        added("issues_created").alias("issues_created"),
        mean("acceptance").alias("avg_acceptance"),
        distinct("traced_run").alias("trace_records"),
        distinct("trace_ref").alias("trace_count"),
        total("terminal_disposition").alias("terminal_records"),
        total("ledger_disposition").alias("ledger_records"),
        distinct("ledger_pr").alias("ledger_prs"),
        distinct("ledger_followup").alias("ledger_followup_issues"),
        total("ledger_needs_human").alias("ledger_needs_human"),
        mean("ledger_chain_depth").alias("ledger_avg_chain_depth"),
        F.coalesce(F.max(F.when(is_("ledger_chain_depth"), number)), F.lit(0)).alias("ledger_max_chain_depth"),
        total("ledger_policy_action").alias("ledger_policy_records"),
        total("ledger_depth_exceeded").alias("ledger_depth_exceeded"),
    )


def freshness_counters(records: DataFrame, by: str) -> DataFrame:
    """(by, counter, value, n) of records(by, json) on the age of a tool: states, packages, versions, targets to update, and steps behind.

    The counters major, minor and patch hold the steps behind; their greatest value is the largest delta. A text that
    is no JSON object, or null, is a record of unknown state, package and versions.
    """
    rows = records.select(by, F.coalesce(F.from_json("json", FRESHNESS), F.from_json(F.lit("{}"), FRESHNESS)).alias("r"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    version = lambda c: F.coalesce(F.nullif(F.regexp_extract(blank(c), VERSION, 1), F.lit("")), blank(c), F.lit("unknown"))
    steps = {k: F.greatest(F.coalesce(_whole(F.col(f"r.version_delta.{k}")), F.lit(0)), F.lit(0)).cast("string") for k in ("major", "minor", "patch")}
    targets = F.transform("r.update_targets", lambda t: blank(t["path"]))
    state = F.coalesce(F.translate(F.lower(blank(F.col("r.status"))), "_", "-"), F.lit("unknown"))
    named = {"status": state, "package": F.coalesce(blank(F.col("r.package")), F.lit("unknown")), "pinned": version(F.col("r.pinned_version")), "latest": version(F.col("r.latest_version"))}
    return _counted(rows, by, named | steps | {"target[]": targets})
