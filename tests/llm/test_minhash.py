from __future__ import annotations

import random

import numpy as np
import pytest

from sparkloom.llm import minhash, runtime
from sparkloom.llm.graph import components
from sparkloom.llm.textkit import shingle_sets, text_chunks, word_bounds
from tests.llm import brute

SCHEMA = "doc_id bigint, text string"


def texts() -> dict[int, str | None]:
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    out: dict[int, str | None] = {}
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 80, 200)))]
        for _ in range(12):
            own = [rng.choice(vocabulary) if rng.random() < rng.choice((0.0, 0.01, 0.03, 0.06)) else w for w in base]
            out[len(out)] = " ".join(own).upper() if family % 2 else " \t".join(own) + "\n"
    for text in (None, "", "  \n", "one", "One", "one two three", "one two three four five", "é ü ß ñ", "a " * 3000):
        out[len(out)] = text
    return out


def test_components_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows.items()], SCHEMA + ", component_id string").repartition(5)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    want = brute.components(rows)
    assert len(got) == len(rows)
    for d, r in got.items():
        assert r["n_shingles"] == len(brute.shingles(rows[d]))
        assert r["component_id"] == want[d]
        assert r["kept"] == (want[d] == d)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rows = texts()
    df = spark.createDataFrame(list(rows.items()), SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == brute.components(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_id_with_several_texts_links_all_that_any_of_them_links(spark):
    rng = random.Random(8)
    a, b = ([rng.choice("abcdefghijklmnop") + str(k) for k in range(60)] for _ in range(2))
    rows = [(1, " ".join(a)), (5, " ".join([*a, "z"])), (5, " ".join(b)), (9, " ".join([*b, "q"])), (5, ""), (7, "alone"), (7, "alone"), (8, None)]
    want = sorted([(1, 1), (5, 1), (5, 1), (9, 1), (5, 5), (7, 7), (7, 7), (8, 8)])
    for parts in (1, 2, 3, 5, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()) == want


def test_a_pair_at_the_threshold_counts_in_large_buckets_too(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    words = [f"w{k}" for k in range(2000)]
    rows = {k: " ".join(words[: 4 + 1500 + d]) for k, d in enumerate((0, 500, 251, 60, 499, 496))}
    df = spark.createDataFrame(list(rows.items()), SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == brute.components(rows)


def test_hot_keys_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(runtime, "LEAST_HOT", 4)
    rows = texts() | {1000 + k: "one and the same text of more than five words" for k in range(40)}
    df = spark.createDataFrame(list(rows.items()), SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == brute.components(rows)
    left, right = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(90)], "key bigint, x bigint"), spark.createDataFrame([(0, "a"), (2, "b")], "key bigint, y string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, runtime.split_join(left, right, "key", how).collect()), key=str) == sorted(map(tuple, left.join(right, "key", how).collect()), key=str)


def test_fewest_matches_follow_the_posterior():
    fewest = minhash._fewest_matches(0.75, 1e-6)
    assert all(0 <= m <= n for n, m in fewest.items())
    rng = np.random.default_rng(1)
    hits = rng.random((20000, minhash.HASHES)) < 0.75
    lost = np.zeros(20000, bool)
    for n, m in fewest.items():
        lost |= hits[:, :n].sum(axis=1) < m
    assert lost.mean() < 1e-3


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 200), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100}


@pytest.mark.parametrize("limit", [1, 10, 1 << 20])
def test_words_do_not_cross_rows(limit):
    import pyarrow as pa

    column = pa.array(["ab", None, "cd ef", "", "gh\x0bij é"])
    seen = []
    for first, _, buf, offsets in text_chunks(column, limit=limit):
        starts, ends, row = word_bounds(buf, offsets)
        seen += [(first + int(r), bytes(buf[a:b]).decode()) for a, b, r in zip(starts, ends, row, strict=True)]
    assert seen == [(0, "ab"), (2, "cd"), (2, "ef"), (4, "gh"), (4, "ij"), (4, "é")]
    assert [len(s) for _, _, buf, offsets in text_chunks(column, limit=limit) for s in shingle_sets(buf, offsets)] == [1, 0, 1, 0, 1]
