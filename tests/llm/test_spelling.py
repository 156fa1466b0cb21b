"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import runtime, spelling

LETTERS = "abcdefgéüß"


def near(x: str, y: str) -> bool:
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def plain(counts: dict[str, int]) -> dict:
    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in beside.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(beside[w]), counts.get(form[w]))
    return out


def got(df) -> dict:  # noqa: ANN001
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return {r[0]: tuple(r)[1:] for r in rows}


def made_words(seed: int) -> dict[str, int]:
    rng = random.Random(seed)
    found: dict[str, int] = {}
    for base in ("abcdef", "abababab", "gggggg", "é" * 9, "abcdefgabc" * 4):
        words = {base}
        for _ in range(60):
            w = list(rng.choice(sorted(words)))
            k = rng.randrange(len(w))
            w[k : k + rng.choice((0, 1, 1))] = [rng.choice(LETTERS)] * rng.choice((0, 1, 1))
            if len(w) > 1:
                words.add("".join(w))
        found |= {w: rng.choice((5, 6, 7, 30, 160, 900)) for w in words}
    return found


@pytest.mark.parametrize(("seed", "block"), [(1, 48), (2, 2), (3, 1)])
def test_all_pairs(spark: SparkSession, seed: int, block: int) -> None:
    counts = made_words(seed)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").withColumn("form", F.lit(1))
    assert got(spelling.spelling_variants(df, block=block)) == plain(counts)


def test_hot_blocks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(runtime, "LEAST_HOT", 3)
    monkeypatch.setattr(runtime, "HOT", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        counts = made_words(4)
        df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
        assert got(spelling.spelling_variants(df, block=3)) == plain(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_batches_do_not_cut_blocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        counts = made_words(5)
        df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
        assert got(spelling.spelling_variants(df, block=5)) == plain(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_words(rows: list[tuple], damaged: int) -> dict[str, int]:
    found: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("damaged", [199, 3])
def test_documents(spark: SparkSession, damaged: int) -> None:
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "Ärgerlich ärgerlich, Überfluß×überflüß " * 9), (1, None), (2, ""), (3, "abcdefgh " * 400_000), (3, "abcdefgh " * 3), (4, "q" * 100_000 + " ")]
    rows += [(k, "q" * 100_000 + " " + "q" * 99_999) for k in range(5, 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    expected = plain_words(rows, damaged)
    assert {r.word: r.n for r in spelling.words(docs, damaged=damaged).collect()} == expected
    if damaged == 199:
        assert got(spelling.document_variants(docs)) == plain(expected)


def test_nothing(spark: SparkSession) -> None:
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.document_variants(docs).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs.select(F.lit("x").alias("word"), F.lit(1).alias("n")), times=1)
