"""Alias types, trace carriers and trees, ledgers, and the streams of spans and attempts against plain versions."""

from __future__ import annotations

import json
import random
import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aliases, ledger, traces
from sparkloom.plans.registry import shared_folder
from sparkloom.streaming import events, spans

ALIASES = [("pitchbook", "pitchbook"), ("pitch_book", "pitchbook"), ("tear_sheet", "tear_sheet"), ("ddq", "ddq"), ("due_diligence_questionnaire", "ddq")]


def alias_table(spark):
    return spark.createDataFrame([(a, k, i) for i, (a, k) in enumerate(ALIASES)], "alias string, kind string, ord int")


# --- aliases ------------------------------------------------------------------------------


def test_ids_by_alias(spark):
    want = {"ddq": "ddq", " Stub_DDQ ": "ddq", "ddq_template": "ddq", "fund tear-sheet": "tear_sheet", "not_a_pitch_book": None, "no_ddq": None, "not_ddq_x": None, "ddq_not": "ddq", "x_ddq_y": None, "xddq": None, "tear": None, "": None, "due-diligence questionnaire v2": "ddq", "pitch_book_ddq": "pitchbook", None: None}
    ids = spark.createDataFrame([(x, 1) for x in [*want, "ddq"]], "library_id string, ord int")
    got = aliases.id_types(ids, alias_table(spark)).collect()
    assert len(got) == len(want) + 1
    assert {r["library_id"]: r["kind"] for r in got} == want
    assert aliases.id_types(ids, alias_table(spark).limit(0)).where("kind is not null").count() == 0
    assert aliases.id_types(ids.limit(0), alias_table(spark)).count() == 0


def plain_text_type(text, library):
    for library_id, kind in library:
        parts = [re.escape(p) for p in re.split(r"[\s_-]+", library_id) if p]
        if re.search(r"(?<![a-z0-9])" + r"[\s_-]+".join(parts) + r"(?![a-z0-9])", (text or "").lower(), re.ASCII):
            return kind
    return None


def test_texts_by_library(spark, monkeypatch):
    monkeypatch.setattr(aliases, "BLOCK", 3)
    rng = random.Random(5)
    words = ["tear", "sheet", "ddq", "r&d", "x", "Pitch", "book", "é", "a.b"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "-", "_", ". ", "  ", "\n"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += [None, "", "TEAR - _sheet", "tear. sheet", "xtear sheet", "r&d  ddq", "word " * 30_000 + "pitch book"]
    library = [("stub_tear-sheet", 2), ("r&d_ddq", 1), ("pitch book", 3), ("no_ddq", 0), ("odd (x) tear_sheet", 4), ("", 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, content string")
    got = {r["document_id"]: r["kind"] for r in aliases.text_types(docs.withColumn("kind", F.lit("x")).withColumn("term", F.lit(1)), spark.createDataFrame(library, "library_id string, ord int"), alias_table(spark)).collect()}
    plain = [("r&d ddq", "ddq"), ("tear sheet", "tear_sheet"), ("pitch book", "pitchbook"), ("odd (x) tear sheet", "tear_sheet")]
    assert got == {i: plain_text_type(t, plain) for i, t in enumerate(texts)}
    assert len(set(got.values())) == 4


# --- trace contexts -----------------------------------------------------------------------


def test_carriers(spark):
    rows = [("t1", "r1", None, "s1", {"b": 'q"\\', "a": "ü\n"}), ("t2", "", "p", None, {}), (" ", "r", None, None, {"a": "b"}), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "trace string, run string, parent string, span string, tags map<string,string>")
    carrier = traces.inject("x-trace-", F.col("tags"), F.col("trace"), F.col("run"), F.col("parent"), F.col("span"))
    got = df.select(carrier.alias("c")).withColumn("e", traces.extract("x-trace-", F.col("c"))).collect()
    assert got[0]["c"] == {"x-trace-id": "t1", "x-trace-run-id": "r1", "x-trace-parent-span-id": "s1", "x-trace-tags": json.dumps(rows[0][4], sort_keys=True)}
    assert got[1]["c"] == {"x-trace-id": "t2", "x-trace-parent-run-id": "p"}
    assert got[0]["e"].asDict() == {"trace_id": "t1", "run_id": "r1", "parent_run_id": None, "parent_span_id": "s1", "tags": rows[0][4]}
    assert got[1]["e"]["tags"] == {} and got[2]["e"] is None and got[3]["e"] is None
    raw = ['{"a": 1, "b": true, "c": null, "d": "x"}', "[1]", "{broken", ""]
    read = spark.createDataFrame([({"x-trace-id": "t", "x-trace-tags": t},) for t in raw] + [({},), (None,)], "c map<string,string>").select(traces.extract("x-trace-", F.col("c")).alias("e")).collect()
    assert [r["e"] and r["e"]["tags"] for r in read] == [{"a": "1", "b": "True", "c": "None", "d": "x"}, {}, {}, {}, None, None]


def test_trees_of_spans(spark):
    rng = random.Random(3)
    rows = {0: (None, {"u": "root", "v": "0"})}
    rows |= {i: (i - 1, {"u": str(i)} if i % 40 == 0 else None) for i in range(1, 200)}
    rows |= {1000 + i: (0, {}) for i in range(300)}
    rows |= {2000 + i: (rng.choice([2000 + rng.randrange(100), 5000, None]), {"w": str(i)}) for i in range(100)}
    rows |= {3000: (3000, {"x": "own"}), 3001: (3000, {"y": "below"})}
    df = spark.createDataFrame([(i, p, t, "extra") for i, (p, t) in rows.items()], "span_id int, parent_id int, tags map<string,string>, root string")
    got = {r["span_id"]: (r["root"], r["depth"], r["tags"], r["issue"]) for r in traces.trees(df, shared_folder(spark)).collect()}
    want = {}
    for i, (parent, tags) in rows.items():
        way, at = [i], parent
        while at is not None and at in rows and at not in way:
            way.append(at)
            at = rows[at][0]
        if at is not None and at in rows:
            want[i] = (None, None, tags or {}, "cycle")
            continue
        held = {}
        for n in reversed(way):
            held |= rows[n][1] or {}
        want[i] = (way[-1], len(way) - 1, held, "orphan" if parent is not None and parent not in rows else None)
    assert got == want
    assert {w[3] for w in want.values()} == {None, "orphan", "cycle"}
    assert traces.trees(df.limit(0), shared_folder(spark)).count() == 0


# --- ledgers ------------------------------------------------------------------------------


def test_ledger_counts_each_value_once(spark):
    records = [
        {"run_id": 5, "verdict": "pass", "pr": 7, "langsmith_traces": [{"trace_id": "a"}, {"langsmith_trace_id": "b"}, {"trace_id": "a"}]},
        {"run_id": 5, "verdict": "pass", "pr_number": "x", "langsmith_trace_url": " u ", "issues_created": "2", "acceptance_criteria_count": 4},
        {"pr": 7, "verdict": "", "codex_model": " Old ", "acceptance_criteria_count": "3"},
        {"verdict": "fail"},
        {"schema": ledger.TERMINAL, "terminal_state": "done", "run_id": 9, "langsmith_trace_id": "z"},
        {"schema": ledger.LEDGER, "chain_depth": 3, "followup_policy": {"trigger": "t", "depth_limit_exceeded": 1}, "needs_human": True, "verdict": "no"},
        {"schema": ledger.LEDGER, "chain_depth": "2", "disposition": "needs-human", "followup_issue_number": 4},
        None,
        [1],
    ]
    rows = [("g", i, None if r is None else json.dumps(r)) for i, r in enumerate(records)]
    counted = ledger.verifier_counters(spark.createDataFrame(rows, "repo string, ord int, json string"), "repo", ("old",))
    got = {(r["counter"], r["value"]): r["n"] for r in counted.collect()}
    assert got["verdict", "pass"] == 2 and ("verdict", "no") not in got and got["unsupported_disposition", "unknown"] == 1
    assert got["terminal_source", "unknown:unknown"] == 1 and got["terminal_disposition", "done"] == 1
    assert {v for c, v in got if c == "run"} == {"run:5:attempt:", "pr:7", "entry:3", "entry:7", "entry:8"}
    one = ledger.verifier_summary(counted, "repo").collect()[0].asDict()
    assert one == {
        "repo": "g", "runs": 5, "prs": 1, "issues_created": 2, "avg_acceptance": 3.5, "trace_records": 1, "trace_count": 3, "terminal_records": 1, "ledger_records": 2, "ledger_prs": 0,
        "ledger_followup_issues": 1, "ledger_needs_human": 2, "ledger_avg_chain_depth": 2.5, "ledger_max_chain_depth": 3, "ledger_policy_records": 1, "ledger_depth_exceeded": 1,
    }
    age = [("g", json.dumps({"status": "Up_To date", "version_delta": {"major": 2, "minor": None}, "update_targets": [{"path": "a"}, {"path": "a"}, {"path": " "}, {}]})), ("g", None)]
    got = {(r["counter"], r["value"]): r["n"] for r in ledger.freshness_counters(spark.createDataFrame(age, "repo string, json string"), "repo").collect()}
    assert got["target", "a"] == 2 and got["status", "up-to date"] == 1 and got["major", "2"] == 1 and got["pinned", "unknown"] == 2
    assert ledger.freshness_counters(spark.createDataFrame([], "repo string, json string"), "repo").count() == 0


# --- streams ------------------------------------------------------------------------------

BEGIN = datetime(2024, 1, 1, tzinfo=UTC)


def stream_of(spark, folder, batches, schema):
    """A stream with one file, and so one batch, for each list of rows."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1 if i < len(batches) - 1 else 0)  # files are taken by their time of change
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))



def minute(n):
    return BEGIN + timedelta(minutes=n)


def test_spans_in_time_late_and_lost(spark, tmp_path):
    batches = [
        [("a", "start", minute(0)), ("b", "start", minute(1)), ("c", "end", minute(2)), (None, "start", minute(2))],
        [("a", "end", minute(30)), ("b", "end", minute(90)), ("c", "start", minute(95)), ("d", "start", minute(96))],
        [("z", "start", minute(300)), ("z", "end", minute(301))],
        [("w", "start", minute(303))],
        [("d", "end", minute(97)), ("y", "start", minute(302))],
        [("y", "start", minute(600)), ("x", "end", minute(600))],
    ]
    stream = stream_of(spark, tmp_path / "in", batches, "span_id string, kind string, at timestamp")
    got = sorted((r["span_id"], r["ended_at"] is not None) for r in events.drained(spans.paired_spans(stream), shared_folder(spark)).collect())
    assert got == [("a", True), ("b", False), ("c", False), ("d", False), ("w", False), ("y", False), ("z", True)]


def plain_outcome(rows):
    first = {}
    for ord_, provider, ok in sorted(rows):
        first.setdefault(provider, (ord_, bool(ok)))
    tried = sorted((o, p, ok) for p, (o, ok) in first.items())[:2]
    tried = tried[:1] if tried[0][2] else tried
    used = next((p for _, p, ok in tried if ok), None)
    failed = sum(not ok for _, _, ok in tried)
    return used, len(tried) - 1, failed, None if used else "ops_review" if failed > 1 else "pending_triage"


@pytest.mark.parametrize("seed", [1, 2])
def test_attempts_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(item, ord_, minute(item + ord_), rng.choice("pqr"), rng.choice([True, False, False, None])) for item in range(40) for ord_ in range(rng.randrange(1, 6))]
    rows += [(None, 0, minute(1), "p", True), (5, 9, minute(5), None, True)]
    rng.shuffle(rows)
    half = len(rows) // 2
    batches = [rows[:half], rows[half:], [(99, 0, minute(600), "p", False)]]
    stream = stream_of(spark, tmp_path / "in", batches, "item_id bigint, ord bigint, at timestamp, provider string, succeeded boolean")
    with spans.rocksdb_state(spark):
        got = events.drained(spans.attempt_outcomes(stream, timedelta(minutes=60), "2 hours"), shared_folder(spark)).collect()
    want = {}
    for item, ord_, _, provider, ok in rows:
        if item is not None and provider is not None:
            want.setdefault(item, []).append((ord_, provider, ok))
    assert len(got) == len(want)
    assert {r["item_id"]: (r["provider_used"], r["retry_count"], r["failure_count"], r["route"]) for r in got} == {k: plain_outcome(v) for k, v in want.items()}


def state_rows(spark, folder):
    """How many state values a drained stream leaves behind."""
    (checkpoint,) = folder.glob("stream-*/checkpoint")
    return spark.read.format("statestore").load(str(checkpoint)).count()


def test_attempts_share_state_and_calls(spark, tmp_path):
    rows = [(item, 0, minute(0), "p", False) for item in range(3000)] + [(1, 1, minute(1), "q", True), (2, None, minute(2), "q", None)]
    stream = stream_of(spark, tmp_path / "in", [rows, [(5000, 0, minute(30), "p", True)]], "item_id bigint, ord bigint, at timestamp, provider string, succeeded boolean")
    got = events.drained(spans.attempt_outcomes(stream, timedelta(minutes=60), "5 minutes"), str(tmp_path))
    assert got.count() == 0
    assert 0 < state_rows(spark, tmp_path) <= 1024  # a value for each item before

    late = [(1, 2, minute(40), "p", False), (6000, 0, minute(90), "p", True)]
    stream = stream_of(spark, tmp_path / "in2", [rows, late], "item_id bigint, ord bigint, at timestamp, provider string, succeeded boolean")
    got = {r["item_id"]: r for r in events.drained(spans.attempt_outcomes(stream, timedelta(minutes=60), "5 minutes", buckets=7), str(tmp_path / "b")).collect()}
    assert len(got) == 3000 and all(r["opened_at"].minute == 0 for r in got.values())
    plain = lambda k: (got[k]["provider_used"], got[k]["retry_count"], got[k]["failure_count"], got[k]["route"])
    assert plain(0) == (None, 0, 1, "pending_triage") and plain(1) == ("q", 1, 1, None) and plain(2) == (None, 1, 2, "ops_review")


def test_lifecycles_share_state_and_calls(spark, tmp_path):
    first = [(item, 0, "received") for item in range(3000)] + [(None, 0, "received"), (None, 1, "received"), (7, 2, "escalated"), (7, 1, "processing")]
    second = [(7, 0, "received"), (8, 3, None), (8, 2, "processing"), (None, 2, "completed"), (2**60 + 1, 0, "completed")]
    stream = stream_of(spark, tmp_path / "in", [first, second], "item_id bigint, ord bigint, to_state string")
    rows = events.drained(events.lifecycle_stream(stream), str(tmp_path), "update").collect()
    assert len(rows) == 3001 + 4  # an item has a row for each batch that touches it
    last = {r["item_id"]: (r["state"], r["moves"], r["illegal"]) for r in sorted(rows, key=lambda r: r["batch"])}
    assert last[7] == ("escalated", 3, 1) and last[8] == ("processing", 2, 1) and last[9] == ("received", 1, 0)
    assert last[None] == ("received", 1, 1) and last[2**60 + 1] == ("", 0, 1)
    assert state_rows(spark, tmp_path) <= 1025  # a value for each item before
