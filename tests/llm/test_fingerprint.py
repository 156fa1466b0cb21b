from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import fingerprint

SCHEMA = "doc_id bigint, text string"


def texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé𝒳") for _ in range(rng.randrange(1, 9)))
    return ["\n".join(". ".join(" ".join(word() for _ in range(7)) for _ in range(rng.randrange(1, 9))) + "." for _ in range(rng.randrange(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("rows", [3, 1000])
def test_edited_texts_and_equality(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", rows)
    own = texts(40)
    data = [(k * k - 5, own[k % 37] if k % 9 else (None if k % 2 else "")) for k in range(40)]
    df = spark.createDataFrame([(*r, 0) for r in data], SCHEMA + ", part int").repartition(4)
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(df).collect()}
    assert len(got) == len(data)
    order = sorted(data)
    prints: dict = {}
    for k, (d, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        assert got[d]["n_chars"] == len(text)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), d
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        prints.setdefault(text, set()).add(got[d]["fingerprint"])
        if text == edited:
            assert got[d]["near_edited"] == 1
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_likeness_follows_what_is_shared(spark):
    own = texts(30, 2)
    df = spark.createDataFrame(list(enumerate(own)), SCHEMA)
    got = fingerprint.edited_fingerprints(df).collect()
    long_ = [r for r in got if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in long_) / len(long_) > 0.3
    assert sum(r["near_next"] for r in long_) / len(long_) < 0.15


def test_sum_ignores_order_and_takes_insertions_and_deletions(spark):
    a, b, c = texts(3, 3)
    lines = [x for t in (a, b, c) for x in t.split("\n")]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(reversed(lines))), (3, "\n".join(lines[1:])), (4, lines[0]), (5, None)], SCHEMA)
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(df).collect()}
    assert got[1] == got[2] and got[1] != got[3]
    assert set(got[5].split("-")[0]) == {"0"}
    by = {k: fingerprint.lanes(df.where(f"doc_id = {k}")).select(F.col("lanes").alias(f"l{k}")) for k in (1, 3, 4)}
    both = by[1].crossJoin(by[3]).crossJoin(by[4])
    found = both.select(fingerprint.print_of(fingerprint.inserted(F.col("l3"), F.col("l4"))), fingerprint.print_of(fingerprint.deleted(F.col("l1"), F.col("l4")))).head()
    assert found[0] == got[1] and found[1] == got[3]


def true_likeness(a: str, b: str) -> float:
    x, y = (Counter(u for line in t.split("\n") for u in re.split(r"[.!?]+(?:\s+|$)", line) if u) for t in (a, b))
    both, own = sum(n * y[u] for u, n in x.items()), sum(n * n for n in [*x.values(), *y.values()])
    return 2 * both / own if own else float(x == y)


def test_likeness_is_near_the_true_one(spark):
    own = [t for t in texts(60, 4) if len(t) > 500]
    own = [x for k, t in enumerate(own) for x in (t, "\n".join(t.split("\n")[: 1 + k % 3]) + "\n" + own[k - 1])] + ["the same line\n" * 1000, "the same line\n" * 500, "x", ""]
    df = spark.createDataFrame(list(enumerate(own)), SCHEMA)
    got = {r["doc_id"]: r["near_next"] for r in fingerprint.edited_fingerprints(df).collect()}
    want = [true_likeness(a, b) for a, b in zip(own, own[1:] + own[:1], strict=True)]
    assert max(abs(got[k] - x) for k, x in enumerate(want)) < 0.35
    assert abs(sum(got[k] - x for k, x in enumerate(want))) / len(want) < 0.06
    assert got[len(own) - 4] == pytest.approx(0.8)


def test_ranges_hold_about_as_many_rows_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 50)
    monkeypatch.setattr(fingerprint, "LEAST_HOT", 100)
    ids = [*range(1000), 2**60, *[-7] * 400, *[None] * 300]
    data = [(d, f"text {k}") for k, d in enumerate(ids)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    parts = fingerprint._parts(df.withColumn("h", F.xxhash64("text")))[0].groupBy("part").count().collect()
    assert len(parts) >= 20 and max(r["count"] for r in parts) <= 200
    got = fingerprint.edited_fingerprints(df).collect()
    hashed = dict(df.select("text", F.xxhash64("text")).collect())
    order = [t for _, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, hashed[x[1]]))]
    want = Counter(hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter(r["edited_sha256"] for r in got) == want


def test_single_repeated_null_and_no_rows(spark):
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(7, "ab\ncd")], SCHEMA)).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"ab\nab").hexdigest()
    rows = [(None, "first"), (None, "first"), (3, "xx"), (3, "xx")]
    assert fingerprint.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).count() == 4
    assert fingerprint.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sums_of_very_many_equal_sentences_do_not_run_over(spark):
    n = 10_000_000
    one = F.struct(F.lit(None).cast("string").alias("paragraph"), F.lit("The same again").alias("sentence"))
    row = fingerprint._lane_sums(spark.range(n).select(F.lit(1).alias("key"), one.alias("u")), ["key"]).head()
    fields = [x & 0xFFFFFFFF for x in row["signs"]] + [x >> 32 for x in row["signs"]]
    assert row["n_sentences"] == n and set(fields) == {0, n}


def test_likeness_of_texts_with_over_a_million_sentences(spark):
    n = (1 << 20) + 50_000
    own = [". ".join(f"{'t' if k and i % 4 == 0 else 's'}{i}" for i in range(n)) for k in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(own)), SCHEMA)
    row = fingerprint.edited_fingerprints(docs).where("doc_id = 0").head()
    assert abs(row["near_next"] - 0.75) < 0.25 and abs(row["near_edited"] - 0.5) < 0.35


def test_texts_of_one_id_are_summed(spark):
    own = texts(30, 5)
    df = spark.createDataFrame([(7, t) for t in own] + [(8, "\n".join(own))], SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in fingerprint.lanes(df).collect()}
    assert got[7]["lanes"]["wide"] == got[8]["lanes"]["wide"] and got[7]["n_paragraphs"] == got[8]["n_paragraphs"]
