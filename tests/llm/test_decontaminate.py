from __future__ import annotations

import random

from sparkloom.llm.decontaminate import contaminated

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["plain", "river", "stone", "walks", "under", "green", "light", "seven", "paper", "house", "quick", "table"]) + str() for _ in range(n))


def test_verbatim_and_reparameterised_items_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(2)
    item = "A train leaves the city of Paris at 40 km per hour and another leaves at 60 km per hour so when do both trains meet each other again"
    other = "Take the sum of all the numbers that come before the third row of the old table and then write it down below the last line"
    short = "what is the capital of Peru"
    docs = [
        (1, sentence(rng, 50) + " " + item + " " + sentence(rng, 50)),
        (2, sentence(rng, 20) + "\n" + item.replace("40", "35").replace("60", "90").replace("Paris", "London") + "."),
        (3, sentence(rng, 200)),
        (4, other.upper() + " " + sentence(rng, 5)),
        (5, " ".join(item.split()[:9]) + " " + sentence(rng, 60)),
        (6, "and then what is the capital of Peru they said"),
        (7, None),
        (8, ""),
        (9, item + " and " + item.replace("40", "35")),
        (1, sentence(rng, 3)),
        (None, item),
    ]
    items = [(10, item), (11, other), (12, short), (13, "too short"), (14, None), (None, item)]
    got = contaminated(spark.createDataFrame([(*d, 5) for d in docs], DOCS + ", item_id int"), spark.createDataFrame(items, ITEMS)).collect()
    found = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in got}
    assert set(found) == {(1, 10), (2, 10), (4, 11), (6, 12), (9, 10)}
    assert found[1, 10] and not found[2, 10]
    assert len(got) == len(found)


def plain_pairs(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """The pairs for texts of plain words, by trying every diagonal."""
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = text.split(), item.split()
            held, tokens, run = set(), 0, 0
            for shift in range(1 - len(b), len(a)):
                same = [0 <= shift + k < len(a) and a[shift + k] == b[k] for k in range(len(b))]
                covered = [False] * len(b)
                for length in (8, 6) if len(b) < 26 else (8,):
                    for k in range(len(b) - length + 1):
                        if all(same[k : k + length]):
                            covered[k : k + length] = [True] * length
                            held |= {k} if length == 8 else set()
                tokens = max(tokens, sum(covered))
                run = max(run, *(len(x) for x in "".join("x" if c else " " for c in covered).split(" ")))
            if len(held) >= 0.5 * (len(b) - 7) or run >= 13 or (len(b) < 26 and tokens >= max(8, len(b) - 6)):
                out.add((d, i))
    return out


def test_pairs_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("plain river stone walks under green light paper house quick table often never while after every small large".split())
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 45)))) for k in range(30)]
    docs = []
    for k in range(150):
        own = items[k % 30][1].split()
        a, b = sorted(rng.randrange(len(own) + 1) for _ in range(2))
        part = [word() if rng.random() < 0.03 else w for w in own[a:b]]
        docs.append((k, " ".join([*(word() for _ in range(rng.randrange(20))), *part, *(word() for _ in range(rng.randrange(20)))])))
    got = contaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    want = plain_pairs(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 30


def test_texts_that_share_an_id_are_compared_apart(spark):
    rng = random.Random(5)
    item, other = sentence(rng, 40), sentence(rng, 40)
    halves = [" ".join(item.split()[:11]), " ".join(["x"] * 11 + item.split()[11:20])]
    rows = [(1, halves[0]), (1, halves[1]), (2, item), (2, other), (3, other)]
    want = None
    for parts in (1, 3, 5):
        docs, items = spark.createDataFrame(rows, DOCS).repartition(parts), spark.createDataFrame([(7, item), (7, other), (8, other)], ITEMS).repartition(parts)
        got = sorted(map(tuple, contaminated(docs, items).collect()))
        assert {(r[0], r[1]) for r in got} == {(2, 7), (2, 8), (3, 7), (3, 8)}
        assert got == (want := want or got)


def test_inconsistent_slots_do_not_match(spark):
    item = "start with 5 apples then take 5 more apples and again give 5 of the apples to the boy and keep the 5 that are left for later"
    same = item.replace("5", "8")
    mixed = item
    for k in range(4):
        mixed = mixed.replace(" 5 ", f" {k + 20} ", 1)
    got = contaminated(spark.createDataFrame([(1, same), (2, mixed)], DOCS), spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert [(r["doc_id"], r["verbatim"]) for r in got] == [(1, False)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g h i")], DOCS), spark.createDataFrame([], ITEMS)
    assert contaminated(docs, items).count() == 0
    assert contaminated(docs.where("false"), spark.createDataFrame([(1, "a b c d e f g h i")], ITEMS)).count() == 0


def test_equal_items_and_very_long_texts(spark):
    rng = random.Random(3)
    item = sentence(rng, 30)
    docs = spark.createDataFrame([(1, sentence(rng, 30000) + " " + item)], DOCS)
    got = contaminated(docs, spark.createDataFrame([(1, item), (2, item)], ITEMS)).collect()
    assert sorted(r["item_id"] for r in got) == [1, 2]


def numbered(first: int, n: int) -> list[str]:
    return [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(first, first + n)]


def test_partial_passages_and_copies_with_one_changed_word_are_found(spark):
    rng = random.Random(4)
    docs, items, want = [], [(1, " ".join(numbered(0, 200)))], set()
    docs.append((1, " ".join([sentence(rng, 40), *numbered(70, 60), sentence(rng, 40)])))
    docs.append((2, " ".join([sentence(rng, 40), *numbered(70, 9), sentence(rng, 40)])))  # nine words are no passage
    want.add((1, 1))
    for n in range(14, 31):
        own = [w + "x" * n for w in numbered(0, n)]
        items.append((n, " ".join(own)))
        for at in range(n):
            docs.append((1000 * n + at, " ".join([sentence(rng, 20), *own[:at], "changed", *own[at + 1 :], sentence(rng, 20)])))
            want.add((1000 * n + at, n))
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_one_odd_value_numbers_and_short_items(spark):
    rng = random.Random(5)
    words = numbered(0, 60)
    words[12] = words[45] = "40"
    item = " ".join(words)
    row = "3 14 15 92 65 35 89 79 32 38 46 26 43 38 32 79"
    docs = [
        (1, sentence(rng, 20) + " " + " ".join([*words[:45], "45", *words[46:]]) + " " + sentence(rng, 20)),
        (2, sentence(rng, 20) + " " + row + " " + sentence(rng, 20)),
        (3, sentence(rng, 20) + " " + row.replace("3", "4") + " " + sentence(rng, 20)),
        (4, "they asked: Name the Capital, " * 3 + sentence(rng, 20)),
        (5, "name the big capital"),
        (6, "one 7 8 9"),
        (7, "one 7 8 8"),
    ]
    items = [(1, item), (2, row), (3, "name the capital"), (4, "7 8 9")]
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 2), (4, 3), (6, 4)]
