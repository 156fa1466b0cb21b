"""What a query reads, deals and holds as its tables grow."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import aliases, contracts, packets, quality, text, traces, vectors
from sparkloom.plans import aliases as plans_aliases
from sparkloom.plans import files as plans_files
from sparkloom.plans import reports
from sparkloom.sources import records
from tests.test_kernels import clustered, pairs_of, plain_first


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_walks_records_once(spark):
    records = spark.createDataFrame([(1, "alpha", '{"a": {"b": {"c": 1}}}'), (2, "alpha", '{"": {"cost": 1}}')], "id int, repo string, json string")
    participants = spark.createDataFrame([("alpha", "emitting")], "repo string, status string")
    required = spark.createDataFrame([("alpha", "cost")], "repo string, section string")
    manifests = records.select("id", F.lit("a").alias("artifact_id"), F.lit("x").alias("sha256"))
    rows = contracts.contract_issues(records, "id", {"type": "object"}, participants, required, manifests)
    # levels 0 to 3, sections and artifacts; a section below a name that is empty is none of the record's own
    assert plan_of(rows).count("parse") <= 6
    assert sorted((r.id, r.path, r.rule) for r in rows.collect()) == [(1, "cost", "section_absent"), (2, "cost", "section_absent")]


def test_first_disagreements_deal_large_keys_apart(spark):
    rng = random.Random(6)
    rows = [(entity, rng.randrange(60), f"s{rng.randrange(9)}", f"{100 + rng.randint(-8, 8)}") for entity in range(40) for _ in range(rng.randrange(1, 25))]
    rows = list(set(rows))
    df = spark.createDataFrame([(e, "aum", o, s, v) for e, o, s, v in rows], "entity int, key string, ord bigint, source string, value string")
    got = quality.first_disagreements(df, 5.0, blocks=4, share=12)
    assert {r.entity: (r.left_source, r.left_value, r.right_source, r.right_value) for r in got.collect()} == plain_first(rows, 5.0)
    few = quality.first_disagreements(df.withColumn("key", F.lit("aum")), share=100)
    deals = re.findall(r"hashpartitioning\((\w+)#\d+, (\d+)\)", physical(few))
    assert deals and set(deals) == {("both", str(len(rows) // 100 + 1))}


def test_ownership_deals_documents_to_more_tasks(spark):
    rng = random.Random(12)
    rows = [(d, rng.randrange(6), rng.choice([None, 1, 2, 3, 4])) for d in range(60) for _ in range(rng.randrange(1, 20))]
    df = spark.createDataFrame(rows, "document_id int, package_id int, at int")
    want = set()
    for d in range(60):
        mine = [(at if at is not None else -1, p) for x, p, at in rows if x == d]
        want |= {(d, p, min(mine)[1]) for _, p in mine if p != min(mine)[1]}
    for share in (10, 50):
        got = packets.ownership_conflicts(df, share).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    deals = re.findall(r"hashpartitioning\((\w+)#\d+, (\d+)\)", physical(packets.ownership_conflicts(df, 50)))
    assert deals == [("document_id", str(len(rows) // 50 + 1))]


def test_small_rows_that_make_files_are_dealt(spark, tmp_path):
    root = f"file://{tmp_path}"
    files = spark.range(40).select(F.concat(F.lit("a"), "id", F.lit("/run.json")).alias("path"), F.to_json(F.struct("id")).alias("body"))
    records.write_files(files, root, "one")
    assert records.merged_manifest(spark, root).select("part").distinct().count() > 2
    assert {r.problem for r in records.read_files(spark, root).collect()} == {None}
    plan = plan_of(records.read_files(spark, root))
    assert "binaryFile" not in plan and "manifest.ndjson" not in plan
    pictures = plans_files.visual_files(spark, "/root/testdata/sf0.001")
    assert pictures.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism * 4


def test_visual_labels_read_a_text_once(spark):
    plan = plan_of(reports.visual_classify(spark, "/root/testdata/sf0.001"))
    assert plan.count(r"fy\d{2}") == 1 and "regexp_count" not in plan
    texts = ["", "a", "1a.b c", "x " * 5, "x " * 6, "9" + "x-" * 40, "é a é" * 9, "x " * 17, "x_1%,\n" * 18, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = F.regexp_count("t", F.lit(text.TOKEN))
    for row in df.select(counted.alias("n"), *[F.rlike("t", F.lit(text.TOKENS % k)).alias(f"k{k}") for k in (6, 18)]).collect():
        assert row.n is None and row.k6 is row.k18 is None or (row.k6, row.k18) == (row.n >= 6, row.n >= 18)


def test_trees_write_a_closed_span_once(spark, tmp_path):
    spans = spark.range(64).select(F.col("id").alias("span_id"), F.when(F.col("id") > 40, F.col("id") - 1).alias("parent_id"), F.lit(None).cast("map<string,string>").alias("tags"))
    assert {r.span_id: r.depth for r in traces.trees(spans, str(tmp_path)).collect()} == {i: max(0, i - 40) for i in range(64)}
    written = [spark.read.parquet(str(p)) for p in sorted(tmp_path.glob("trees-*/round-*"))]
    assert sum(x.where("up is null").count() for x in written) == 64


def test_texts_are_read_once_and_only_first_tokens_make_rows(spark, tmp_path):
    plan = physical(plans_aliases.library_text_types(spark, "/root/testdata/sf0.001"))
    # the items are made once, documents are exchanged and not n-grams, and the library is read as it was written
    assert plan.count("regexp_extract_all") == 1 and "array_union" not in plan
    assert not re.search(r"hashpartitioning\((term|library_id|p_name)#", plan)
    texts = ["", None, "old ring", "OLD\t-ring x", "old, ring", "old  hot ring", "r&d lab", "r&dlab", "x " * 9000 + "cold_hot-ring", "x " * 4095 + "old ring", "ring", "hot", "\u00e9old ring\u00e9"]
    want = [None, None, "r", "r", None, "h", "l", None, "h", "r", None, None, "r"]
    names = spark.createDataFrame([("old_ring", "r", 1), ("hot_ring", "h", 2), ("r&d_lab", "l", 0), ("cold_hot_ring", "c", 3)], "alias string, kind string, ord int")
    library = names.select(F.col("alias").alias("library_id"), "ord")
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, content string")
    for most in (1 << 18, 3, 2, 0):  # all are broadcast, the first tokens only, or nothing
        for folder in (None, str(tmp_path)):
            got = aliases.text_types(docs, library, names, folder, most).collect()
            assert {r.document_id: r.kind for r in got} == dict(enumerate(want)) and len(got) == len(want)


def shuffle_bytes(spark, run):
    """What run() gives, and the bytes it shuffles."""
    scala = spark.sparkContext._jsc.sc()

    def written() -> int:
        scala.listenerBus().waitUntilEmpty()
        executors = scala.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    return run(), written() - before


def test_similar_pairs_shuffle_few_copies_and_no_pair(spark):
    x = clustered(8, groups=2500, dim=64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got, moved = shuffle_bytes(spark, lambda: vectors.similar_pairs(df, recall=0.9999).collect())
    assert {(r.a, r.b) for r in got} == pairs_of(x, 0.8)
    assert moved < 30 * x.nbytes, moved / x.nbytes  # 114 times before
    centre = np.random.default_rng(9).normal(size=16)
    dense = (centre + np.random.default_rng(10).normal(size=(6000, 16)) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense)], "vec_id bigint, embedding array<float>")
    n, moved = shuffle_bytes(spark, lambda: vectors.similar_pairs(df).count())
    assert n > 0.99 * len(pairs_of(dense, 0.8)) and moved < n, (n, moved)  # less than a byte a pair


def test_similar_pairs_are_given_once(spark):
    x = clustered(11, groups=200)
    odd = [(7000, [float("nan")] * 24), (7001, [float("inf")] + [1.0] * 23), (7002, [1.0] * 23 + [None])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id bigint, embedding array<double>")
    want = pairs_of(x, 0.8)
    for block, probes in ((300, 3), (40, 1), (40, 0), (40, 20), (2, 3)):  # 2: codes of two letters
        got = [(r.a, r.b) for r in vectors.similar_pairs(df, recall=0.999, block=block, probes=probes).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want), (block, probes, len(got), len(want))
    wide = np.concatenate([x[:90]] * 30, axis=1)  # 720 numbers, which count as 11 rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id bigint, embedding array<float>")
    for exact in (True, False):
        got = [(r.a, r.b) for r in vectors.similar_pairs(df, recall=0.9999, block=30, exact=exact).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs_of(wide, 0.8)
