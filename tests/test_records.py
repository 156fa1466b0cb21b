from __future__ import annotations

import json
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import records


def test_lines_have_sorted_keys_and_keep_their_order(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(k, "é\"\\", (k, None)) for k in range(50)], "z int, a string, m struct<y:int,b:string>").repartitionByRange(3, "z").sortWithinPartitions("z")
    records.write_lines(rows, root, "first")
    got = [r["line"] for r in records.read_lines(spark, root).orderBy("path", F.expr("cast(get_json_object(line, '$.z') as int)")).collect()]
    assert got == [json.dumps({"z": k, "a": "é\"\\", "m": {"y": k, "b": None}}, sort_keys=True, separators=(",", ":")) for k in range(50)]
    listed = records.merged_manifest(spark, root).orderBy("part", "position").collect()
    assert [r["part"] for r in listed] == [0, 1, 2] and sum(r["records"] for r in listed) == 50
    for r in listed:
        data = (Path(root) / "data" / r["path"]).read_bytes()
        assert (r["sha256"], r["bytes"]) == (sha256(data).hexdigest(), len(data))
    assert (Path(root) / "data" / listed[0]["path"]).read_text().splitlines() == got[: listed[0]["records"]]


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(0, 40, 1, 4)
    broken = F.when(F.col("id") == 33, F.lit("record 33 has no owner"))
    with pytest.raises(Exception, match="record 33 has no owner"):
        records.write_lines(rows, root, "b1", broken)
    assert records.read_lines(spark, root).isEmpty() and records.merged_manifest(spark, root).isEmpty()
    with pytest.raises(Exception, match="record 33 has no owner"):
        records.write_lines(rows.coalesce(1), f"{root}/one-task", "b1", broken)
    assert list((tmp_path / "one-task" / "data").glob("*")) == []
    records.write_lines(rows, root, "b1")
    # what an attempt left behind without a commit is not read
    job = tmp_path / "data" / json.loads((tmp_path / "committed" / "b1.json").read_text())["job"]
    lost = job / "part-00000-0123"
    lost.mkdir()
    (lost / records.LINES).write_text('{"id":99}\n')
    (lost / "manifest.ndjson").write_text('{"part":0,"position":0,"path":"x","records":1}\n')
    assert records.read_lines(spark, root).count() == 40
    with pytest.raises(Exception, match="already committed"):
        records.write_lines(rows, root, "b1")
    assert records.read_lines(spark, root).count() == 40


def test_files_of_their_own(spark, tmp_path):
    root = str(tmp_path)
    files = [(f"run{k}/{name}.json", json.dumps({"b": k, "a": [{"d": 1, "c": None}]})) for k in range(6) for name in ("run", "metadata")]
    records.write_files(spark.createDataFrame(files, "path string, body string"), root, "runs")
    got = {r["path"].split("/files/")[1]: r for r in records.read_files(spark, root).collect()}
    assert {p: bytes(r["content"]).decode() for p, r in got.items()} == {p: json.dumps(json.loads(b), indent=2, sort_keys=True) + "\n" for p, b in files}
    assert all(r["problem"] is None for r in got.values())
    (tmp_path / "data" / got["run0/run.json"]["path"]).write_text("{}")
    (tmp_path / "data" / got["run1/run.json"]["path"]).unlink()
    problems = {r["path"].split("/files/")[1]: r["problem"] for r in records.read_files(spark, root).where("problem is not null").collect()}
    assert problems == {"run0/run.json": "changed", "run1/run.json": "missing"}


@pytest.mark.parametrize(("path", "message"), [("../x.json", "plain relative"), ("/x.json", "plain relative"), (None, "no path"), ("a.json", "twice")])
def test_bad_paths_fail_the_write(spark, tmp_path, path, message):
    rows = spark.createDataFrame([("a.json", "{}"), (path, "{}")], "path string, body string")
    with pytest.raises(Exception, match=message):
        records.write_files(rows, str(tmp_path), "b")
    assert records.merged_manifest(spark, str(tmp_path)).isEmpty()


def test_manifests_of_batches_are_merged_in_order_and_empty_ones_count(spark, tmp_path):
    root = str(tmp_path)
    for batch in ("2024-02", "2024-01"):
        records.write_files(spark.createDataFrame([(f"{batch}-{k}.json", "{}") for k in (2, 1)], "path string, body string").coalesce(1), root, batch)
    records.write_lines(spark.range(0), root, "2024-03")
    got = records.merged_manifest(spark, root).orderBy("batch", "part", "position").collect()
    assert sorted(r["path"].split("/files/")[1] for r in got) == [r["path"].split("/files/")[1] for r in sorted(got, key=lambda r: (r["batch"], r["path"].split("/files/")[1]))]
    assert [r["batch"] for r in got] == ["2024-01"] * 2 + ["2024-02"] * 2
    assert records._commits(spark, root).count() == 3
