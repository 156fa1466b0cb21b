from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.scoring import COMPONENTS, WEIGHTS
from sparkloom.sources import readers, sinks


def test_bundles_and_ndjson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"package_id": "p", "metadata": {"firm_name": "F"}, "files": [{"file_name": "x.pdf"}]}, indent=1))
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text("[1]")
    got = {r["file"]: r for r in readers.bundles(spark, str(tmp_path / "*.json")).collect()}
    assert got["a.json"]["problem"] is None and got["a.json"]["files"][0]["file_name"] == "x.pdf"
    assert (got["b.json"]["problem"], got["c.json"]["problem"]) == ("invalid_json", "not_an_object")
    (tmp_path / "x.ndjson").write_text('{"a": 1}\n\nnope\n[2]\n{"a": 3}\n')
    records, bad = readers.ndjson(spark, str(tmp_path / "x.ndjson"), "a int")
    assert sorted(r["a"] for r in records.collect()) == [1, 3] and bad.count() == 2


def test_weight_files(spark, tmp_path):
    for name, weights in WEIGHTS.items():
        (tmp_path / f"{name}.toml").write_text(f'asset_class = "{name}"\n[weights]\n' + "".join(f"{c} = {w}\n" for c, w in zip(COMPONENTS, weights, strict=True)))
    assert readers.weight_files(spark, str(tmp_path)).count() == 40
    (tmp_path / "macro.toml").write_text('asset_class = "macro"\n[weights]\ntransparency = 2\n')
    with pytest.raises(ValueError, match="macro"):
        readers.weight_files(spark, str(tmp_path))


def test_document_text(spark):
    deck = io.BytesIO()
    with zipfile.ZipFile(deck, "w") as z:
        z.writestr("ppt/presentation.xml", "")
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f"<a:t>slide</a:t><a:t>{k}</a:t>")
    pdf = b"%PDF-1.4\n1 0 obj stream\n(Hello \\(you\\)) Tj (caf\\351\\n) Tj\nendstream\n%%EOF"
    files = spark.createDataFrame([("a.pdf", pdf), ("b.pptx", deck.getvalue()), ("c.pdf", b"junk"), ("d.pptx", b"PKjunk")], "path string, content binary")
    got = [(r["path"], r["page"], r["text"], r["problem"] is None) for r in readers.document_text(files).orderBy("path", "page").collect()]
    assert got == [("a.pdf", 1, "Hello (you)\ncafé\n", True), ("b.pptx", 1, "slide\n2", True), ("b.pptx", 2, "slide\n10", True), ("c.pdf", 0, None, False), ("d.pptx", 0, None, False)]
    assert readers.ooxml_kind("b.pptx", deck.getvalue()) == "pptx"


def test_snapshots(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "id int, v string, created string")
    rows = spark.createDataFrame([(2, "c", "t1"), (3, "d", "t1"), (3, "e", "t2")], "id int, v string, created string")
    values = lambda df: sorted((r["id"], r["v"], r["created"]) for r in df.collect())
    assert values(sinks.upsert(table, rows, ["id"], F.col("created"), keep=("created",))) == [(1, "a", "t0"), (2, "c", "t0"), (3, "e", "t2")]
    assert values(sinks.insert_or_ignore(table, rows, "id", F.col("created"))) == [(1, "a", "t0"), (2, "b", "t0"), (3, "d", "t1")]
    with pytest.raises(Exception, match="duplicate id"):
        sinks.insert(table, rows, "id").collect()
    assert values(sinks.append_numbered(table, rows, "id", F.col("v")))[2:] == [(3, "c", "t1"), (4, "d", "t1"), (5, "e", "t2")]
    for k in (1, 2):
        sinks.write_snapshot(table.withColumn("v", F.lit(str(k))), f"{tmp_path}/t", k)
    assert {r["v"] for r in sinks.newest_snapshot(spark, f"{tmp_path}/t").collect()} == {"2"}


def test_exports_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("=1", 1.5), ("x", None)], "b string, a double")
    sinks.write_csv(rows, f"{tmp_path}/csv")
    assert "'=1,1.5" in {r["value"] for r in spark.read.text(f"{tmp_path}/csv").collect()}
    sinks.write_ndjson(rows, f"{tmp_path}/json")
    assert '{"a":null,"b":"x"}' in {r["value"] for r in spark.read.text(f"{tmp_path}/json").collect()}
    listed = sinks.manifest(spark, f"{tmp_path}/csv").where(F.col("name").startswith("part")).collect()
    assert listed and all(len(r["sha256"]) == 64 for r in listed)
