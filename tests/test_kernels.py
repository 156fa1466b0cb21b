"""Pictures, contracts, the document store, first pairs and similar pairs against plain versions and golden cases."""

from __future__ import annotations

import hashlib
import io
import json
import random
import re
import shutil
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import contracts, quality, vectors
from sparkloom.sources import pictures, store

# --- pictures -----------------------------------------------------------------------------

PDF = (
    b"1 0 obj\n<< /Type /Page /Resources << /XObject << /Im0 5 0 R >> >> >>\nendobj\n2 0 obj\n<< /Type /Page /Resources << /XObject << /Im1 6 0 R >> >> >>\nendobj\n"
    b"5 0 obj\n<< /Subtype /Image /Filter /DCTDecode /Length 3 >>\nstream\nabc\nendstream\nendobj\n6 0 obj\n<< /Subtype /Image /Filter /FlateDecode /Length 3 >>\nstream\ndef\nendstream\nendobj\n"
    b"7 0 obj\n<< /Subtype /Image /Filter /DCTDecode >>\nendobj\n9 0 obj\n<< /Subtype /Image /ColorSpace /DeviceCMYK /Filter /DCTDecode >>\nstream\nink\nendstream\nendobj\n"
    b"8 0 obj\n<< /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /FlateDecode >>\nstream\nxyz\nendstream\nendobj\n"
)


def presentation(slides: dict[int, list[tuple[str, str, str]]], media: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, links in slides.items():
            rels = "".join(f'<Relationship Id="{i}" Type="http://x/relationships/{kind}" Target="{target}"/>' for i, kind, target in links)
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for name, data in media.items():
            z.writestr(name, data)
    return out.getvalue()


def test_pictures_of_files(spark):
    deck = presentation(
        {10: [("rId9", "image", "..\\media\\b.JPG")], 2: [("rId3", "image", "../media/a.png"), ("rId2", "image", "../../media/a.png"), ("rId1", "slideLayout", "../media/a.png"), ("rId4", "image", "../media/gone.png")]},
        {"ppt/media/a.png": b"png-payload", "ppt/media/b.JPG": b"x" * 3_000_000},
    )
    broken_link = presentation({1: []}, {}).replace(b"<Relationships", b"<Relationship<")
    files = [("d1", "m.pdf", PDF), ("d2", "M.PPTX", deck), ("d3", "x.docx", deck), ("d4", "noending", PDF), ("d5", "a.pptx", b"PK\x03\x04"), ("d6", "a.pdf", None), ("d7", "a.pdf", b"nothing"), ("d8", None, PDF), ("d9", "a.pptx", broken_link)]
    df = spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in files], "document_id string, file_name string, content binary")
    rows = pictures.pictures(df.withColumn("page", F.lit(1)).withColumn("problem", F.lit("x"))).collect()
    by = lambda d: [r for r in rows if r.document_id == d]
    assert [(r.page, r.ref, r.media_type, r.reason) for r in by("d1")] == [
        (1, "pdf-object-5", "image/jpeg", None),
        (2, "pdf-object-6", "application/octet-stream", "unsupported_encoding"),
        (0, "pdf-object-8", "application/octet-stream", "raster_not_rebuilt"),
        (0, "pdf-object-9", "application/octet-stream", "unsupported_colorspace"),
    ]
    assert by("d1")[0].sha256 == hashlib.sha256(b"abc").hexdigest() and by("d1")[0].storage_path == "artifacts/d1/pdf/page-1/object-5.jpg"
    assert [(r.slide, r.ref, r.target, r.media_type, r.bytes) for r in by("d2")] == [
        (2, "rId2", "ppt/media/a.png", "image/png", 11),
        (2, "rId3", "ppt/media/a.png", "image/png", 11),
        (10, "rId9", "ppt/media/b.JPG", "image/jpeg", 3_000_000),
    ]
    seed = f"d2|s2|rId2|{hashlib.sha256(b'png-payload').hexdigest()}"
    assert by("d2")[0].artifact_id == "va_" + hashlib.sha1(seed.encode()).hexdigest()[:16]
    assert [r.problem for r in by("d3") + by("d4") + by("d6") + by("d8")] == ["unsupported visual source type: .docx", "unsupported visual source type: <none>", "no content", "unsupported visual source type: <none>"]
    assert by("d5")[0].problem.startswith("BadZipFile") and by("d9")[0].problem.startswith("BadZipFile: Bad CRC") and by("d7") == []
    assert pictures.pictures(df.limit(0)).collect() == []
    kinds = df.select("document_id", pictures.office_kind(F.col("content")).alias("kind")).collect()
    assert {r.document_id: r.kind for r in kinds} | {"d9": "pptx"} == {"d2": "pptx", "d3": "pptx", "d9": "pptx"} | dict.fromkeys(("d1", "d4", "d5", "d6", "d7", "d8"))


def test_pictures_of_a_folder(spark, tmp_path):
    (tmp_path / "deck.pptx").write_bytes(presentation({1: [("rId2", "image", "../media/a.svg")]}, {"ppt/media/a.svg": b"<svg/>"}))
    (tmp_path / "m.pdf").write_bytes(PDF)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("document_id"), F.col("path").alias("file_name"), "content")
    assert sorted((r.document_id, r.ref) for r in pictures.pictures(files).collect()) == [("deck.pptx", "rId2"), *(("m.pdf", f"pdf-object-{n}") for n in (5, 6, 8, 9))]


# --- contracts ----------------------------------------------------------------------------

SCHEMA = {
    "type": "object",
    "required": ["a", "b"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": ["string", "null"], "minLength": 2, "pattern": "^x"},
        "b": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 9}, "b": {"type": "array", "items": {"type": "number"}}}}},
        "c": {"enum": ["p", "q"]},
    },
}


def plain_issues(value, schema, path=""):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(value)]
    kind = "integer" if kind == "number" and value == int(value) else kind
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if kind not in wanted and not (kind == "integer" and "number" in wanted):
            yield path, "type"
    if "enum" in schema and value not in schema["enum"]:
        yield path, "enum"
    if kind == "string":
        if len(value) < schema.get("minLength", 0):
            yield path, "minLength"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, "pattern"
    if kind in ("integer", "number"):
        if value < schema.get("minimum", value):
            yield path, "minimum"
        if value > schema.get("maximum", value):
            yield path, "maximum"
    if kind == "array":
        if len(value) < schema.get("minItems", 0):
            yield path, "minItems"
        if len(value) > schema.get("maxItems", 9**9):
            yield path, "maxItems"
        for k, x in enumerate(value):
            yield from plain_issues(x, schema.get("items", {}), f"{path}[{k}]")
    if kind == "object":
        for name in schema.get("required", []):
            if name not in value:
                yield path, "required"
        if schema.get("additionalProperties") is False and set(value) - set(schema["properties"]):
            yield path, "closed"
        for name, x in value.items():
            yield from plain_issues(x, schema.get("properties", {}).get(name, {}), f"{path}.{name}" if path else name)


def made(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 7)
    if kind < 7:
        return ("x", "xy", "p", -1, 4.0, 2.5, None)[kind]
    if kind == 7:
        return [made(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {k: made(rng, depth + 1) for k in rng.sample("abckz", rng.randrange(5))}


def test_schema_rules_at_any_depth(spark):
    rng = random.Random(3)
    documents = [made(rng) for _ in range(400)]
    documents += [{"a": "xx", "b": [made(rng) for _ in range(rng.randrange(5))], "c": rng.choice("pqr")} for _ in range(200)] + [True, [[[[[[1]]]]]]]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "id int, json string").withColumn("path", F.lit("x"))
    found = contracts.values(df, "id")
    got = sorted((r.id, r.path, r.rule) for r in contracts.violations(found, "id", contracts.rule_table(spark, SCHEMA)).collect())
    want = sorted({(i, *x) for i, d in enumerate(documents) for x in plain_issues(d, SCHEMA)})
    assert sorted(set(got)) == want


def test_broken_deep_and_empty_records(spark):
    deep = "[" * 9 + "1" + "]" * 9
    df = spark.createDataFrame([(1, None), (2, "{"), (3, deep), (4, '{"Prompt": "", "z": {"PII": [], "q": [{"rows": [1]}], "raw_prompt": {"a": 1}}}')], "id int, json string")
    found = contracts.values(df, "id", deepest=5)
    rules = contracts.rule_table(spark, {"type": "object"})
    assert sorted((r.id, r.rule) for r in contracts.violations(found, "id", rules).collect()) == [(1, "json"), (2, "json"), (3, "type")]
    assert found.where("id = 3 and kind = 'deep'").count() == 1
    assert sorted(r.path for r in contracts.raw_payloads(found, "id").collect()) == ["z.q[0].rows", "z.raw_prompt"]
    assert sorted(r.path for r in contracts.sensitive_fields(found, "id", ("prompt",)).collect()) == ["Prompt", "z.raw_prompt"]
    none = contracts.values(df.limit(0), "id")
    assert contracts.violations(none, "id", rules).collect() == []
    for odd in ({"anyOf": []}, {"const": 3}, {"properties": {"a": {"not": {}}}}):
        with pytest.raises(ValueError):
            contracts.compile_rules(odd)


def test_sections_and_manifests(spark):
    envelopes = [(1, "r", '{"cost": {}, "warnings": [], "outputs": {"artifact_ids": ["a", "b", "c", 5]}}'), (2, "r", '{"cost": null}'), (3, "skipped", "{}")]
    records = spark.createDataFrame(envelopes, "id int, repo string, json string")
    required = spark.createDataFrame([("r", "cost"), ("r", "warnings"), ("r", "other")], "repo string, section string")
    manifests = spark.createDataFrame([(1, "a", "f"), (1, "b", ""), (1, "b", None)], "id int, artifact_id string, sha256 string")
    participants = spark.createDataFrame([("r", "emitting"), ("skipped", "none"), ("x", None)], "repo string, status string")
    rows = contracts.contract_issues(records, "id", {"type": "object"}, participants, required, manifests).collect()
    assert sorted((r.id, r.rule, r.detail) for r in rows) == [
        (1, "no_hash_in_manifest", "b"),
        (1, "not_in_manifest", "c"),
        (1, "section_empty", "cost"),
        (1, "section_unknown", "other"),
        (2, "section_absent", "cost"),
        (2, "section_absent", "warnings"),
        (2, "section_unknown", "other"),
    ]


# --- document store -----------------------------------------------------------------------

ARRIVALS = "document_key string, file_name string, content binary, received_at string, ord bigint"


def test_store(spark, tmp_path):
    root = str(tmp_path / "s")
    store.create(spark, root)
    assert store.versions(spark, root).collect() == []
    first = spark.createDataFrame([("k/1", "a", bytearray(b"one"), "2024-02-01", 1), ("k/1", "b", bytearray(b"one"), "2024-01-01", 2), ("k/1", "c", bytearray(b"two"), "2024-01-05", 3), ("k2", "d", bytearray(b"one"), "2024-01-01", 4), ("k3", "e", None, "2024-01-01", 5)], ARRIVALS)
    assert [store.put(first, root), store.put(first, root)] == [4, 0]
    listed = store.versions(spark, root).where("document_key = 'k/1'").orderBy("batch_number", "received_at").collect()
    assert [(v.file_name, v.received_at, v.byte_size) for v in listed] == [("b", "2024-01-01", 3), ("c", "2024-01-05", 3)]
    blobs = spark.read.schema(store.BLOBS).parquet(f"{root}/blobs")
    assert blobs.count() == 3
    assert store.get_one(spark, root, "k/1", listed[0].version_id) == b"one"
    again = spark.createDataFrame([("k/1", "late", bytearray(b"one"), "2030-01-01", 9), ("k/1", "new", bytearray(b"three"), "2020-01-01", 8)], ARRIVALS)
    assert store.put(again, root) == 1
    order = [v.file_name for v in store.versions(spark, root).where("document_key = 'k/1'").orderBy("batch_number", "received_at").collect()]
    assert order == ["b", "c", "new"]
    asked = spark.createDataFrame([("k/1", listed[0].version_id), ("k/1", "never"), ("k2", listed[0].version_id)], "document_key string, version_id string")
    assert {(r.document_key, r.version_id == "never"): r.present for r in store.get(asked, root).collect()} == {("k/1", False): True, ("k/1", True): False, ("k2", False): True}
    with pytest.raises(KeyError):
        store.get_one(spark, root, "k/1", "never")


def test_a_put_that_breaks_off_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "s")
    store.create(spark, root)
    rows = spark.createDataFrame([("k", "a", bytearray(b"one"), "2024-01-01", 1)], ARRIVALS)
    store.put(rows, root)
    for part in ("blobs", "index"):
        own = next(p for p in (tmp_path / "s" / part).iterdir() if p.name.startswith("batch="))
        shutil.copytree(own, own.with_name("batch=halfway"))
    assert store.versions(spark, root).count() == 1 and store.put(rows, root) == 0
    # a lost blob is written again, though its version is known
    shutil.rmtree(next(p for p in (tmp_path / "s" / "blobs").iterdir() if p.name.startswith("batch=") and "halfway" not in p.name and any(p.glob("prefix=*"))))
    (tmp_path / "s" / "blobs").mkdir(exist_ok=True)
    version = store.versions(spark, root).head().version_id
    with pytest.raises(KeyError):
        store.get_one(spark, root, "k", version)
    assert store.put(rows, root) == 0 and store.get_one(spark, root, "k", version) == b"one"


def test_point_reads_are_pruned(spark, tmp_path):
    root = str(tmp_path / "s")
    store.create(spark, root)
    store.put(spark.range(50).select(F.lit("k").alias("document_key"), F.lit("f").alias("file_name"), F.col("id").cast("string").cast("binary").alias("content"), F.lit("2024-01-01").alias("received_at"), F.col("id").alias("ord")), root)
    wanted = hashlib.sha256(b"7").hexdigest()
    plan = store.blob(spark, root, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "prefix#" in plan and f"= {wanted[:2]})" in plan.split("PartitionFilters")[1].split("]")[0]
    assert store.blob(spark, root, wanted).count() == 1


# --- first pairs --------------------------------------------------------------------------


def plain_first(rows, tolerance):
    by = {}
    for entity, ord_, source, value in sorted(rows):
        m = re.search(r"-?\d+(\.\d+)?", value)
        if m:
            by.setdefault(entity, []).append((ord_, source, value, float(m[0])))
    out = {}
    for entity, own in by.items():
        own.sort()
        pair = next(((a, b) for i, a in enumerate(own) for b in own[i + 1 :] if abs(a[3] - b[3]) / max(abs(a[3]), abs(b[3]), 1e-12) * 100 > tolerance), None)
        if pair:
            out[entity] = (*pair[0][1:3], *pair[1][1:3])
    return out


@pytest.mark.parametrize(("tolerance", "blocks"), [(5.0, 256), (0.0, 3), (40.0, 1), (100.0, 4)])
def test_first_disagreement(spark, tolerance, blocks):
    rng = random.Random(blocks)
    rows = []
    for entity in range(120):
        base = rng.choice((100, -100, 0, 7))
        spread = rng.choice((1, 4, 30, 250))
        rows += [(entity, rng.randrange(-20, 20 * entity + 1), f"s{rng.randrange(9)}", rng.choice([f"{base + rng.randint(-spread, spread)}"] * 9 + ["n/a"])) for _ in range(rng.randrange(1, 30))]
    rows = list(set(rows))
    df = spark.createDataFrame([(e, "aum", o, s, v) for e, o, s, v in rows], "entity int, key string, ord bigint, source string, value string").withColumn("number", F.lit("x")).withColumn("block", F.lit(1))
    got = quality.first_disagreements(df, tolerance, blocks).collect()
    assert {r.entity: (r.left_source, r.left_value, r.right_source, r.right_value) for r in got} == plain_first(rows, tolerance)
    assert all(r.reason.startswith(f"cross_check_disagreement:aum:{r.left_source}!={r.right_source}:") for r in got)
    assert quality.first_disagreements(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        quality.first_disagreements(df, 101)


# --- similar pairs ------------------------------------------------------------------------


def clustered(seed, groups=300, size=3, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = np.repeat(centres, size, 0) + rng.normal(size=(groups * size, dim)) * rng.choice([0.1, 0.35, 0.6], (groups * size, 1))
    return x.astype(np.float32)


def pairs_of(x, least):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= least, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


def test_similar_pairs(spark):
    x = clustered(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [1.0])], "vec_id bigint, embedding array<float>").withColumn("code", F.lit(1))
    want = pairs_of(x, 0.8)
    exact = vectors.similar_pairs(df, exact=True, block=64).collect()
    assert {(r.a, r.b) for r in exact} == want and len(exact) == len(want)
    assert all(abs(r.closeness - 1 / (2 - r.similarity)) < 1e-9 for r in exact)
    for block in (512, 16):  # 16: more bits, and buckets that have to be split
        got = {(r.a, r.b) for r in vectors.similar_pairs(df, block=block).collect()}
        assert got <= want and len(got) >= 0.97 * len(want), (block, len(got), len(want))
    assert vectors.similar_pairs(df.limit(0)).collect() == []


def test_hot_bucket_and_classes(spark):
    rng = np.random.default_rng(2)
    x = (np.ones(8) + rng.normal(size=(200, 8)) * 0.02).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, block=32).collect()}
    assert got == pairs_of(x, 0.8)
    classes = {r.vec_id: r.class_id for r in vectors.vector_classes(df).collect()}
    assert classes == {i: i if i < 200 else 0 for i, _ in rows}


def test_tables_grow_with_what_is_asked():
    few, many = vectors.tables_needed(0.8, 8, 3, 0.9), vectors.tables_needed(0.8, 8, 3, 0.999)
    assert 1 <= few < many < vectors.tables_needed(0.8, 16, 3, 0.999) and many > vectors.tables_needed(0.95, 8, 3, 0.999)


# --- names, fingerprints, records ---------------------------------------------------------


def test_names_fold_as_the_product_does(spark):
    from sparkloom.functions.strings import normalized_name
    from sparkloom.operators.packets import merged_aliases

    rows = spark.createDataFrame([("Große  ﬁnanz LLC",), ("ＡＣＭＥ, Inc.",), (None,), ("STRASSE lp",)], "name string")
    assert [r[0] for r in rows.select(normalized_name(F.col("name"))).collect()] == ["grosse finanz", "acme", None, "strasse"]
    merged = spark.createDataFrame([(["Straße LLC"], " STRASSE ")], "aliases array<string>, name string").select(merged_aliases(F.col("aliases"), F.col("name")).alias("m")).head().m
    assert [(x.normalized, x.name) for x in merged] == [("strasse", "STRASSE"), ("strasse", "Straße LLC")]


def test_fingerprints_equal_canonical_json(spark):
    from sparkloom.operators import tooling

    inputs = [{"b": 'q"\\/\n\t\x01\x7f', "a": "äß€𝒳"}, {}, {"é": "plain"}, {'"': ""}]
    df = spark.createDataFrame([(f"wé{i}", x, None if i else "old") for i, x in enumerate(inputs)], "workflow string, inputs map<string,string>, previous string")
    rows = tooling.state_fingerprints(df, "v1").collect()
    for i, (r, x) in enumerate(zip(rows, inputs, strict=True)):
        text = json.dumps({"workflow": f"wé{i}", "inputs": x, "version": "v1"}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        assert r.fingerprint == hashlib.sha256(text.encode()).hexdigest()
    assert [r.reason for r in rows] == ["fingerprint-changed"] + ["no-prior-fingerprint"] * 3


def test_records_by_key_whatever_it_holds(spark):
    from sparkloom.operators import tooling

    cases = {
        '{"verdict": null}': "verifier", '{"schema":"workflows-codex-cli-freshness/v1"}': "codex_cli_freshness", '{"metric_type":"","workflow":"AUTOFIX"}': "autofix", '{"type":"verify"}': "verifier", '{"type":"cycle"}': "autopilot",
        '{"metric_type": 5, "type": "keepalive"}': "unknown", '{"metric_type": 0, "type": "keepalive"}': "keepalive", '{"step_name":"a"}': "unknown", '{"step_name":"a","duration_ms":null}': "autopilot", "not json": "unknown", '["verdict"]': "unknown",
    }
    rows = spark.createDataFrame(list(cases.items()), "json string, want string").select("json", "want", tooling.record_class(F.col("json")).alias("got")).collect()
    assert {r.json: r.got for r in rows} == cases
    slow = spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.1)], "run_id int, nodeid string, time double")
    assert [r.nodeid for r in tooling.slowest(slow, 5, 1.0).collect()] == ["a"]
    runs = spark.createDataFrame([("x", 0, 4, None, 7), ("x", 2, 9, 3, 7)], "kind string, iteration_count int, iteration int, pr_number int, pr int")
    row = tooling.keepalive_summary(runs.withColumns({"stop_reason": F.lit(""), "tasks_total": F.lit(0), "tasks_complete": F.lit(0)}), "kind").head()
    assert (row.prs, row.avg_iterations) == (2, 3.0)


def test_similar_pairs_hash_in_several_tasks(spark):
    x = clustered(5, groups=3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = vectors.similar_pairs(df)
    want = pairs_of(x, 0.8)
    got = {(r.a, r.b) for r in found.collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unit" in plan and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()  # one task hashed all before, as the vectors are small
