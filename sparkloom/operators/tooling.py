"""Kernels of the tooling: record classes, summaries, test reports, coverage, fingerprints, logs and rotation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The classes of metric records in order of rules, and signs of failures in logs.
SCHEMAS = {"workflows-terminal-disposition/v1": "terminal_disposition", "workflows-verifier-followup-ledger/v1": "verifier_followup_ledger", "workflows-codex-cli-freshness/v1": "codex_cli_freshness"}
WORDS = (("keepalive", "keepalive"), ("autofix", "autofix"), ("verifier", "verifier"), ("verify", "verifier"))
SIGNS = (("keepalive", ("iteration_count", "stop_reason", "tasks_total")), ("autofix", ("attempt_number", "trigger_reason", "fix_applied")), ("verifier", ("verdict", "issues_created", "acceptance_criteria_count")))
CASES = "testcase array<struct<_classname:string,_name:string,_time:double,failure:string,error:string,skipped:string>>"


def record_class(json: Column) -> Column:
    """The class of a JSON object: by its schema, by what it calls itself, then by the keys that it has, whatever they hold.

    What it calls itself is the first of metric_type, type and workflow that is not empty, null, false or 0; only
    a text is a name. What is no object is unknown.
    """
    record = F.try_parse_json(json)
    keys = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
    text = lambda k: F.try_variant_get(record, f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(record, f"$.{k}", "variant"))
    empty = lambda k: F.coalesce((kind(k) == "VOID") | (kind(k) == "OBJECT<>") | text(k).isin("", "false", "0", "[]"), kind(k).isNull())
    named = F.coalesce(*[F.when(~empty(k), F.when(kind(k) == "STRING", F.lower(text(k))).otherwise("")) for k in ("metric_type", "type", "workflow")])
    has = lambda names: reduce(lambda a, b: a | b, [F.array_contains(keys, k) for k in names])
    rules = [F.when((kind("schema") == "STRING") & (text("schema") == schema), c) for schema, c in SCHEMAS.items()]
    rules += [F.when(F.contains(named, F.lit(w)), c) for w, c in WORDS]
    rules += [F.when(named.isin("step", "cycle", "escalation"), "autopilot")]
    rules += [F.when(has(names), c) for c, names in SIGNS]
    rules += [F.when(F.array_contains(keys, "step_name") & F.array_contains(keys, "duration_ms") | F.array_contains(keys, "escalation_reason"), "autopilot")]
    return F.coalesce(*rules, F.lit("unknown"))


def counters(rows: DataFrame, by: str, *names: str) -> DataFrame:
    """(by, counter, value, n): how often each value of some columns occurs; null and empty values are left out."""
    each = rows.select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("counter"), F.col(k).cast("string").alias("value")) for k in names])))
    return each.where("value <> ''").groupBy(by, "counter", "value").agg(F.count("*").alias("n"))


def keepalive_summary(rows: DataFrame, by: str) -> DataFrame:
    """Runs, distinct pulls, mean iterations and completed runs of rows(pr_number, iteration, stop_reason, tasks_total, tasks_complete).

    Where rows has them, iteration_count comes before iteration, and pr after pr_number; 0 counts as not given.
    """
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit(0)), b) if a in rows.columns and b in rows.columns else F.col(a if a in rows.columns else b)
    rows = rows.withColumns({"iteration": first("iteration_count", "iteration"), "pr_number": first("pr_number", "pr")})
    done = (F.col("stop_reason") == "tasks-complete") | ((F.col("tasks_total") > 0) & (F.col("tasks_complete") >= F.col("tasks_total")))
    return rows.groupBy(by).agg(F.count("*").alias("runs"), F.count_distinct("pr_number").alias("prs"), F.round(F.coalesce(F.avg("iteration"), F.lit(0.0)), 6).alias("avg_iterations"), F.count_if(done).alias("tasks_complete"))


def autofix_summary(rows: DataFrame, by: str) -> DataFrame:
    """Attempts, distinct pulls and fixes applied; true is written true, True or 1."""
    applied = F.lower(F.col("fix_applied").cast("string")).isin("true", "1")
    return rows.groupBy(by).agg(F.count("*").alias("attempts"), F.count_distinct("pr_number").alias("prs"), F.count_if(applied).alias("fixes_applied"))


def step_summary(rows: DataFrame) -> DataFrame:
    """Mean duration, successes and failures by step of rows(step_name, duration_ms, success)."""
    return rows.groupBy("step_name").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def test_cases(reports: DataFrame) -> DataFrame:
    """(run_id, nodeid, time, status) of the cases of reports(run_id, xml), in the form that test runners write."""
    suite = F.from_xml("xml", CASES, {"attributePrefix": "_"})
    cases = reports.select("run_id", F.explode(suite["testcase"]).alias("c"))
    status = F.when(F.col("c.failure").isNotNull(), "failure").when(F.col("c.error").isNotNull(), "error").when(F.col("c.skipped").isNotNull(), "skipped").otherwise("passed")
    return cases.select("run_id", F.concat_ws("::", "c._classname", "c._name").alias("nodeid"), F.coalesce("c._time", F.lit(0.0)).alias("time"), status.alias("status"))


def slowest(cases: DataFrame, n: int, min_seconds: float = 0.0) -> DataFrame:
    """The n slowest cases of each run that took at least min_seconds, by time and then name."""
    return cases.where(F.col("time") >= min_seconds).withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("time"), "nodeid"))).where(F.col("place") <= n)


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def coverage_delta(rows: DataFrame, alert_drop: float, fail_on_drop: bool = False) -> DataFrame:
    """rows(run_id, current, baseline) with delta, drop and status."""
    drop = F.when(F.col("baseline") > 0, F.greatest(F.lit(0.0), F.col("baseline") - F.col("current"))).otherwise(0.0)
    status = F.when(F.col("baseline") <= 0, "no-baseline").when((drop > 0) & (drop >= alert_drop), "fail" if fail_on_drop else "alert").otherwise("ok")
    return rows.select("run_id", F.round(F.col("current") - F.col("baseline"), 4).alias("delta"), F.round(drop, 4).alias("drop"), status.alias("status"))


def coverage_hotspots(files: DataFrame, n: int, below: float) -> DataFrame:
    """The n files of each run with the least coverage, ties by path, and whether each is below the threshold."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("percent", "path"))
    return files.withColumn("place", place).where(F.col("place") <= n).withColumn("low", F.col("percent") < below)


def top_files(files: DataFrame, n: int) -> DataFrame:
    """The n files of each run that miss most lines; where none misses any, the n largest."""
    lacks = F.max("missing").over(Window.partitionBy("run_id")) > 0
    own = files.withColumn("lacks", lacks).where(~F.col("lacks") | (F.col("missing") > 0))
    order = F.when(F.col("lacks"), F.col("missing")).otherwise(F.col("total"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(order.desc(), "percent", "path"))).where(F.col("place") <= n).drop("lacks")


def json_text(text: Column) -> Column:
    """A text as a JSON string in ASCII: quotes, backslashes, control signs and all beyond ASCII escaped, the latter by their UTF-16 units."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        unit = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))
        pair = F.concat(unit(F.floor((code - 0x10000) / 1024) + 0xD800), unit((code - 0x10000) % 1024 + 0xDC00))
        out = reduce(lambda done, kv: done.when(c == kv[0], kv[1]), short.items(), F.when(F.lit(False), c))
        return out.when((code >= 32) & (code < 127), c).when(code < 0x10000, unit(code)).otherwise(pair)

    plain = F.rlike(text, F.lit(r'^[ !#-\[\]-~]*$'))
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), "")), F.lit('"'))


def state_fingerprints(rows: DataFrame, version: str) -> DataFrame:
    """The SHA-256 of rows(workflow, inputs map, previous) as canonical JSON in ASCII, whether it changed, and why it is run or not."""
    pairs = F.transform(F.array_sort(F.map_entries("inputs")), lambda x: F.concat(json_text(x["key"]), F.lit(":"), json_text(x["value"])))
    text = F.concat(F.lit('{"inputs":{'), F.array_join(pairs, ","), F.lit('},"version":'), json_text(F.lit(version)), F.lit(',"workflow":'), json_text(F.col("workflow")), F.lit("}"))
    out = rows.withColumn("fingerprint", F.sha2(text, 256))
    reason = F.when(F.col("previous").isNull(), "no-prior-fingerprint").when(F.col("previous") == F.col("fingerprint"), "fingerprint-match").otherwise("fingerprint-changed")
    return out.withColumns({"changed": ~F.col("fingerprint").eqNullSafe(F.col("previous")), "reason": reason}).drop("inputs", "previous")


def log_evidence(logs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """By file and sign: how many lines of logs(file, content) hold it, and the first of them."""
    lines = logs.select("file", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    each = lines.select("file", "line", F.explode(F.array_compact(F.array(*[F.when(F.rlike("text", F.lit(p)), k) for k, p in patterns.items()]))).alias("sign"))
    return each.groupBy("file", "sign").agg(F.count("*").alias("lines"), F.min("line").alias("first_line"))


def rotating_sample(samples: DataFrame, order: str, index: Column) -> DataFrame:
    """The sample of each group(group, rotation) whose place in order is the rotation modulo their number."""
    w = Window.partitionBy("group")
    placed = samples.withColumns({"_place": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return placed.where(F.pmod(index, F.col("_n")) == F.col("_place")).drop("_place", "_n")
