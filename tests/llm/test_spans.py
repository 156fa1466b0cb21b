from __future__ import annotations

import math
import random
import re
import time

import pytest

from sparkloom.llm import pii, secrets
from tests.llm import brute

PIECES = [
    "a.b@c.de", "a@b.c%x@d.e", "@x.y", "x@y", "x@y.z.", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "001.02.3.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (269) 555-3296",
    "+1 2", "+491234567890123456", "++49 151 1234567", "4532015112830366", "9" * 30, "ü", "\n", " ", "word", "-", "٣٤", "𝒳", "mail: ",
]
SECRET_PIECES = [
    "password=", "Password: ", "API_KEY = '", 'token": "', "secret:", "abcdefghijkl", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEF0123456789", "hunter2", " ", "\n", "é", "=", ":", "Tr0ub4dor&3xQ!", "pKey", "passwd=ab.cd/ef+gh-ij_kl=", "A" * 20,
]


def pieced(pieces: list[str], n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_pii_base_spans_equal_plain_patterns(spark):
    texts = [None, "", *pieced(PIECES, 300, 3), "1" * 30000, "a" * 30000 + "@b.c", "4 " * 20000, "1.2.3.4 " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert len(got) == len(texts)
    for d, text in enumerate(texts):
        want = brute.pii_spans(text or "")
        assert got[d]["base_spans"] == brute.joined(want), text
        assert [got[d][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(k == s[0] for s in want) for k in pii.BASE_KINDS]
        assert set(filter(None, got[d]["base_spans"].split(","))) <= set(got[d]["spans"].split(","))


def test_pii_adds_likely_spans_and_keeps_rows(spark):
    rows = [(k, f"please call 555-867-{5300 + k} or write to jane.doe (at) example.com") for k in range(20)]
    rows += [(None, "x"), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int")
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    assert all(r["n_email"] == 0 for r in got)
    assert pii.find_pii(df.where("false")).count() == 0


def test_overlaps_are_settled_among_accepted_spans(spark):
    rows = [(1, "email", 0, 10, True), (1, "phone", 8, 20, False), (1, "ssn", 20, 30, False), (1, "iban", 25, 40, False), (1, "phone", 50, 60, False), (1, "card", 55, 70, True), (2, "phone", 0, 5, False), (2, "ssn", 5, 9, False), (3, None, None, None, False)]
    df = spark.createDataFrame([(r[0], r[1], r[1] or "", *r[2:]) for r in rows], "row_id bigint, kind string, pattern string, start int, `end` int, base boolean")
    got = sorted((r["row_id"], r["kind"] or "", r["start"]) for r in pii._settled(df).collect())
    assert got == [(1, "card", 55), (1, "email", 0), (1, "ssn", 20), (2, "phone", 0), (2, "ssn", 5), (3, "", None)]


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = random.Random(1)
    cells: dict = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        right = 1 if truth else -1
        seen = (right if rng.random() < 0.95 else -right, 0, right if rng.random() < 0.6 else -right, 0, right if rng.random() < 0.9 else -right)
        cells[seen] = cells.get(seen, 0) + 1
    share, table = pii.reliabilities([("email", v, n) for v, n in cells.items()])
    assert table[0, 1][1] > table[2, 1][1] + 0.2
    assert 0.4 < share["email"] < 0.6


@pytest.mark.parametrize("seed", [1, 2])
def test_secret_base_spans_equal_plain_patterns(spark, seed):
    texts = [None, "", *pieced(SECRET_PIECES, 300, seed), "a" * 50000]
    df = spark.createDataFrame([(d, t, 0) for d, t in enumerate(texts)], "doc_id bigint, text string, n_hex int")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    for d, text in enumerate(texts):
        want = brute.secret_spans(text or "")
        assert got[d]["base_spans"] == brute.joined(want), text
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(k == s[0] for s in want) for k in ("assign", "access", "hex")]
    assert secrets.scan_secrets(df.where("false")).count() == 0


def every_cost(value: str, ranks: dict[str, int]) -> float:
    """The least cost over all segmentations, each tried."""
    low = value.lower()

    def run_end(i: int, goes_on) -> int:
        j = i + 1
        while j < len(low) and goes_on(j):
            j += 1
        return j

    def segments(i: int):
        for j in range(i + 1, len(low) + 1):
            yield j, plain_cost(value[i:j])
            for word, extra in ((low[i:j], 0), (low[i:j].translate(secrets._LEET), math.log10(4))):
                if word in ranks and j - i >= 3:
                    ups = sum(c.isupper() for c in value[i:j])
                    odd = 0 if not ups else math.log10(2) if ups in (1, j - i) else math.log10(math.comb(j - i, ups))
                    yield j, math.log10(ranks[word] + 1) + odd + extra
                    break
            if re.fullmatch(r"(19|20)\d\d", low[i:j]):
                yield j, math.log10(120)
        if (m := secrets._DATE.match(low, i)) and secrets._is_date(m):
            yield m.end(), math.log10(365 * 120) + (math.log10(5) if m["s"] or m["t"] else 0)
        j = run_end(i, lambda k: low[k] == low[k - 1])
        if j - i >= 3:
            yield j, plain_cost(low[i]) + math.log10(j - i)
        for step in (1, -1):
            j = run_end(i, lambda k, step=step: low[k].isalnum() and ord(low[k]) - ord(low[k - 1]) == step)
            if j - i >= 3:
                yield j, math.log10(72) + math.log10(j - i)
        j = run_end(i, lambda k: low[k] in secrets._near.get(low[k - 1], ()))
        if j - i >= 4:
            way = [low[k] > low[k - 1] for k in range(i + 1, j)]
            yield j, math.log10(47) + math.log10(j - i) + (1 + sum(a != b for a, b in zip(way, way[1:], strict=False))) * math.log10(4)

    def least(i: int) -> float:
        return 0.0 if i == len(low) else min(secrets.KIND_COST + cost + least(j) for j, cost in segments(i))

    return least(0)


def test_guess_cost_is_the_least_of_all_segmentations():
    rng = random.Random(4)
    ranks = {"pass": 1, "word": 7, "password": 2, "sword": 40, "and": 3, "tro": 99, "asd": 5}
    values = ["passwordx7", "x7password", "pAsSword", "p4$$word", "asdfgh", "aaaabcd", "19991231", "1-2-1999", "qwedsaz", "12345", "aaa", "tr0and"]
    values += ["".join(rng.choice(("pass", "word", "a", "s", "d", "1", "9", "2000", "Z", "$", "ab", "q", "w")) for _ in range(4))[:8] for _ in range(300)]
    for value in values:
        want = every_cost(value, ranks)
        assert secrets.guess_cost(value, ranks) == pytest.approx(want), value
        assert secrets.guess_cost(value, ranks, 6.0) == (pytest.approx(want) if want < 6 else math.inf), value
    assert secrets.guess_cost("passwordx7kq9z", ranks) == pytest.approx(secrets.guess_cost("x7kq9zpassword", ranks))


@pytest.mark.parametrize("value", ["a", "ab", "qwsa", "password", "x7", "19991231", "abcdefghij", "\u0130"])
def test_guess_cost_of_a_long_value_is_quick(value):
    began = time.perf_counter()
    found = secrets.find_spans("pwd=" + (value * 1_000_000)[:1_000_000] + " pin: xK9#vQ2$mZ7")[1]
    assert time.perf_counter() - began < 2 and found[-1][2] > 1_000_000


def test_ranks_are_learnt_but_credentials_are_not(spark):
    texts = ["elephant giraffe zebra elephant", "pwd=QzkVhWxJqPbT elephant giraffe", "pwd=QzkVhWxJqPbT", None, ""] * 40
    ranks = secrets.word_ranks(spark.createDataFrame([(t,) for t in texts], "text string"))
    n = len(secrets._RANKS)
    assert [ranks[w] - n for w in ("elephant", "giraffe", "zebra")] == [1, 2, 3] and "qzkvhwxjqpbt" not in ranks
    assert secrets.guess_cost("elephantgiraffe1", ranks) < secrets.LEAST_COST < secrets.guess_cost("elephantgiraffe1")
    assert len(secrets.word_ranks(spark.createDataFrame([(t,) for t in texts], "text string"), 2)) == n + 2


def plain_cost(value: str) -> float:
    """Brute-force spans only."""
    return sum(secrets._char_cost(c) for c in value)


@pytest.mark.parametrize("most", [0, 1, 7, 500, 1_999, 2_000, 9_000])
def test_first_words_are_those_of_a_sort_with_ties(spark, most):
    rows = [(f"w{k * 7919 % 2000:04d}", 2 + k % 5 + (k % 97 == 0) * k) for k in range(2_000)]
    counts = spark.createDataFrame(rows, "word string, n bigint")
    assert secrets._first_words(counts, most) == [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))][:most]
    assert secrets._first_words(counts.limit(0), most) == []


def test_guess_cost_knows_what_is_easy():
    for easy in ("password", "qwertyuiop", "aaaaaaaaaa", "abcdefgh", "19991231", "P@ssw0rd", "summer2024"):
        assert secrets.guess_cost(easy) < 0.75 * plain_cost(easy)
    assert secrets.guess_cost("xK9#vQ2$mZ7!") > 12
    assert secrets.guess_cost("") == 0
    assert secrets.guess_cost("x" * 5000) < 10
    assert secrets.guess_cost("İstanbul") > 0


def test_guess_cost_adds_credentials_in_context_only():
    base, added = secrets.find_spans("my password: xK9#vQ2$mZ7! ok")
    assert not base and [(k, "my password: xK9#vQ2$mZ7! ok"[a:b]) for k, a, b in added] == [("guess", "xK9#vQ2$mZ7")]
    assert secrets.find_spans("the code xK9#vQ2$mZ7! ok") == ([], [])
    assert secrets.find_spans("password: password1") == ([], [])


def test_guess_cost_reads_names_with_prefixes_letters_and_values_found_in_part():
    def guessed(text: str) -> list[str]:
        return [text[a:b] for k, a, b in secrets.find_spans(text)[1]]

    for name in ("DB_PASSWORD=", "my_secret: ", "user_pwd = ", "dbPin=", "mypassword=", "app.auth: ", "X-Api-Key: "):
        assert guessed(name + "Tr0ub!4dor&3zQ9x") == ["Tr0ub!4dor&3zQ9x"], name
    assert guessed("pwd=QzkVhWxJqPbT") == ["QzkVhWxJqPbT"]
    assert guessed("pwd=PASSWORDsummer") == [] and guessed("the spin: Tr0ub!4dor&3zQ9x") == []
    assert guessed("password=abcdefghijkl$RestOfSecret") == ["abcdefghijkl$RestOfSecret"]
    assert guessed("password=abcdefghijklRestOfSecret") == []


def test_redaction_leaves_no_rest_of_a_value(spark):
    df = spark.createDataFrame([(1, "a password=abcdefghijkl$RestOfSecret b", 5), (2, "DB_PASSWORD=Tr0ub!4dor&3zQ9x", 5)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    assert got == {1: "a [SECRET] b", 2: "DB_PASSWORD=[SECRET]"}


def test_redaction_removes_every_span(spark):
    df = spark.createDataFrame([(1, "a password=abcdef0123456789abcdef b", 5, None), (2, None, None, "x"), (3, "clean", 5, "y")], "doc_id bigint, text string, n_chars bigint, lang string")
    got = {r["doc_id"]: r for r in secrets.redact_secrets(df).collect()}
    assert got[1]["text"] == "a [SECRET] b" and got[1]["n_chars"] == 12
    assert got[2]["text"] is None and got[3]["text"] == "clean"
    assert secrets.redact_secrets(df).columns == df.columns


@pytest.mark.parametrize("line", ["mail: some.one{k}@host.example.com, ", "from 10.1.2.{k} ", "card 4111 1111 1111 1111 {k}x ", "call +1 (269) 555-32{k}x ", "a(at)b{k}.com ", "123-45-6789, ", "DE89 3704 0044 0532 0130 00; "])
def test_pii_of_a_text_full_of_matches_takes_linear_time(spark, line):
    text = "".join(line.replace("{k}", str(k % 90 + 10)) for k in range(5_000_000 // len(line)))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    row = pii.find_pii(df).head()
    assert time.time() - began < 60
    assert row["base_spans"] == brute.joined(brute.pii_spans(text))
