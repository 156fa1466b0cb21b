from __future__ import annotations

import duckdb
import pytest

from sparkloom.llm import mixing
from tests.llm import brute

SCHEMA = "doc_id bigint, source string, text string"


def rows() -> list[tuple]:
    out = [(k, f"s{k % 7}" if k % 11 else None, " ".join(["w"] * (k % 40 + 1))) for k in range(600)]
    return out + [(600, "empty", None), (601, "empty", ""), (602, "É", "a\u00a0b c"), (603, "Z", "x " * 5000), (None, "Z", "null id")]


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    whole, full = share * sum(sizes.values()), set()
    while True:
        left = whole - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] >= most * sizes[s]}
        if not over:
            return target
        full |= over
        if len(full) == len(order):
            return {s: most * sizes[s] for s in order}


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1.0) for r in data], SCHEMA + ", rate double")
    got = mixing.mix_report(df).collect()
    sizes: dict = {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = plain_targets(sizes)
    taken: dict = {}
    by_id = {d: (s, len(brute.WORD.findall(t or ""))) for d, s, t in data}
    assert len(got) == len(data)
    for r in got:
        source, size = by_id[r["doc_id"]]
        assert r["size"] == size and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * size
        taken[source] = taken.get(source, 0) + r["taken"]
    for s, n in taken.items():
        if s not in ("empty", "Z", "É"):
            assert n == pytest.approx(want[s], rel=0.25)
    again = mixing.mix_report(df.repartition(4)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_the_mix_holds_what_the_report_says(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    report = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_report(df).collect()}
    emitted: dict = {}
    for r in mixing.mix(df).collect():
        size = len(brute.WORD.findall(r["text"] or ""))
        emitted[r["doc_id"], size] = emitted.get((r["doc_id"], size), 0) + size
    assert {k: v for k, v in report.items() if v} == {k: v for k, v in emitted.items() if v}


def test_sql_agrees(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    documents = df.toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(map(str, con.execute(mixing.MIX_SQL).fetchall()))
    got = sorted(str(tuple(r)) for r in mixing.mix_report(df).collect())
    assert got == want


def test_empty_table_and_ranges_of_sources(spark, monkeypatch):
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    monkeypatch.setattr(mixing, "RANKED_PER_TASK", 2)
    df = spark.createDataFrame(rows(), SCHEMA)
    sizes: dict = {}
    for _, s, t in rows():
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = plain_targets(sizes)
    got = {r["source_size"]: r["target"] for r in mixing.mix_report(df).collect()}
    for s, n in sizes.items():
        assert got[n] == pytest.approx(want[s])


def test_columns_of_any_name_come_through_the_mix(spark, tmp_path):
    names = ["rate", "target", "source_size", "copy", "size", "mix_key", "mix_rate", "mix_copies", "weight"]
    data = [(k, f"s{k % 3}" if k % 5 else None, "a b c" if k % 4 else None, *[k] * len(names)) for k in range(60)]
    df = spark.createDataFrame(data, SCHEMA + "".join(f", {n} int" for n in names))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "_copy"]
    mixed.write.parquet(str(tmp_path / "mix"))
    assert all(r["rate"] == r["doc_id"] == r["copy"] for r in mixed.collect())
    plain = mixing.mix(df.select("doc_id", "source", "text"))
    assert sorted(map(str, mixed.select("doc_id", "_copy").collect())) == sorted(str(r).replace("copy", "_copy") for r in plain.select("doc_id", "copy").collect())


def test_rows_without_an_id_or_with_one_id_draw_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PLACED_PER_TASK", 50)
    data = [(None, "a", f"one text {k % 50} of four") for k in range(400)]
    data += [(7, "b", "the same text") for _ in range(2000)] + [(7, None, "the same text")] * 3 + [(k, "c", "w " * 200) for k in range(60)]
    data += [(None, None, None), (None, None, "")]
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(data)
    sizes: dict = {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = plain_targets(sizes)
    by_size = {sizes[s]: s for s in sizes}
    taken: dict = {}
    for r in got:
        taken[by_size[r["source_size"]]] = taken.get(by_size[r["source_size"]], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for s in ("a", "b", "c"):
        assert taken[s] == pytest.approx(want[s], rel=0.1), s
    again = mixing.mix_report(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    documents = df.toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(map(str, con.execute(mixing.MIX_SQL).fetchall())) == sorted(str(tuple(r)) for r in got)
    mixed = mixing.mix(df).groupBy("source").count().collect()
    words = {"a": 5, "b": 3, "c": 200}
    assert all(r["count"] * words[r["source"]] == taken[r["source"]] for r in mixed if r["source"])
