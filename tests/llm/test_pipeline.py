from __future__ import annotations

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkloom.llm.queries import QUERIES
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(tmp_path):
    rng = random.Random(6)
    words = "the weather was fine and they went for long walks with their dog before rain came over hills near old town".split()
    clean = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    item = " ".join(rng.choice(words) for _ in range(30))
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "s0"), (101, clean[4] + " again", "en", "s1"), (102, clean[5] + " " + item, "en", "s2"), (103, "%% 123", "en", "s0"), (104, None, None, None), (105, clean[6][:150] + " password=abcdef0123456789 end", "en", None), (7, clean[7], "en", "s1")]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": [r[3] for r in rows], "n_chars": [len(r[1] or "") for r in rows]})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    return rows, item


def test_each_stage_takes_effect_on_what_the_one_before_kept(spark, tmp_path):
    rows, item = write(tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.stash(stage(spark, docs, str(tmp_path)), name)
        seen[name] = [r.asDict() for r in docs.collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    ids = {name: sorted(r["doc_id"] for r in got) for name, got in seen.items()}
    assert ids["language_id"] == sorted(r[0] for r in rows if r[0] not in (103, 104))
    group = brute.components({d: t for d, t, *_ in rows if d not in (103, 104)})
    assert ids["near_dedup"] == sorted(d for d, g in group.items() if d == g)
    assert ids["decontaminate"] == [d for d in ids["near_dedup"] if d != 102]
    assert ids["secret_scan"] == ids["decontaminate"]
    marked = next(r for r in seen["secret_scan"] if r["doc_id"] == 105)
    assert marked["text"].endswith("[SECRET] end") and marked["n_chars"] == len(marked["text"])
    sizes = sum(len(brute.WORD.findall(r["text"])) for r in seen["secret_scan"])
    taken = sum(len(brute.WORD.findall(r["text"])) for r in seen["mixing"])
    assert 1.2 * sizes < taken < 1.8 * sizes
    assert docs.where(F.col("copy") > 2).isEmpty()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the weather was fine and they went for long walks with their dog before rain came over hills near old town".split()) for _ in range(n))


def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    _, item = write(tmp_path)
    rng = random.Random(9)
    two = [prose(rng, 60), prose(rng, 60)]
    long_ = prose(rng, 200_000)
    rows = [(1, two[0]), (1, two[1]), (1, two[0]), (2, two[1] + " more"), (None, two[0]), (None, item), (3, None), (4, ""), (5, long_), (6, item), (6, prose(rng, 60)), (7, "12 34"), (None, "%%"), (8, prose(rng, 20) + " secret=abcdef0123456789")]
    names = ["kept", "row_key", "text_key", "id", "rate", "copy", "part", "accepted", "row"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {n} string" for n in names)
    data = [(d, t, "en", "s", len(t or ""), *["x"] * len(names)) for d, t in rows]
    for parts in (1, 4):
        docs = spark.createDataFrame(data, schema).repartition(parts)
        got = {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns + ["_copy"] * (name == "mixing")
            got[name] = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.stash(out, name).collect()), key=str)
            assert corpus_pipeline.stash(stage(spark, docs.where("false"), str(tmp_path)), name).isEmpty()
        assert got["language_id"] == sorted(((d, t) for d, t in rows if t and any(c.isalpha() for c in t)), key=str)
        first = (1, min(two))
        assert got["near_dedup"] == sorted([first, (None, two[0]), (None, item), (3, None), (4, ""), (5, long_), (6, min(rows[9][1], rows[10][1])), (7, "12 34"), (None, "%%"), (8, rows[13][1])], key=str)
        assert got["decontaminate"] == sorted([r for r in rows if r[1] != item], key=str)
        assert got["secret_scan"] == sorted([(d, t and t.replace("secret=abcdef0123456789", "[SECRET]")) for d, t in rows], key=str)


def test_run_and_queries_are_registered(spark, tmp_path):
    write(tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 13
    assert all(n.startswith(f"op{k}_") for k, n in enumerate(QUERIES, 1))
