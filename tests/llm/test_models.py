"""Scores of language, toxicity and word-class models, and host trust."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import brown, langid, linkrank, toxicity
from sparkloom.llm.runtime import crc_mod
from sparkloom.llm.textkit import word_hashes
from tests.llm import brute

DOCS = "doc_id bigint, text string"


def two_tongues(n: int) -> list[tuple[int, str]]:
    rng = random.Random(9)
    tongues = [[f"{a}{b}" for a in "bdg" for b in ("ala", "eno", "iru", "omi")], [f"{a}{b}" for a in "ptk" for b in ("isk", "ulf", "ern", "and")]]
    return [(k, " ".join(rng.choice(tongues[k % 2]) for _ in range(rng.randrange(1, 60)))) for k in range(n)]


def plain_class_scores(texts, trains, classes, core_words, head_words):
    """The class model by loops over words, with the exchange itself given: score by row."""
    rows = [[*brute.words(t), None] for t in texts]
    seen = [r for r, own in zip(rows, trains, strict=True) if own]
    steps = Counter(p for r in seen for p in zip([None, *r[:-1]], r, strict=True))
    n = Counter(w for r in seen for w in r if w is not None)
    hashed = {}
    for w in {w for r in rows for w in r if w is not None}:
        buf = np.frombuffer(w.encode(), np.uint8)
        hashed[w] = int(word_hashes(buf, np.array([0]), np.array([len(buf)]))[0])
    level = {w: math.floor(math.log2(c) * 2) for w, c in n.items()}
    t = 0
    while sum(x >= t for x in level.values()) + 1 > head_words + 1:
        t += 1
    head = [w for w in sorted(n, key=lambda w: (-n[w], hashed[w])) if level[w] >= t]
    core = head[:core_words]
    inner = [(core.index(a), core.index(b), c) for (a, b), c in sorted(steps.items(), key=str) if a in core and b in core]
    found = brown.exchange(*(np.array(x) for x in zip(*inner, strict=True)), len(core), classes)
    end, unknown = classes, classes + 1
    cls = {None: end} | {w: int(c) for w, c in zip(core, found, strict=True)}

    def placed(words, known, table):
        """Each word's likeliest class by its neighbours in known."""
        out = {}
        for w in words:
            sums = np.zeros(classes, np.float32)
            for (a, b), c in steps.items():
                for b_own, near, before in ((b == w, a, True), (a == w, b, False)):
                    if b_own and near in known:
                        each = [math.log((table[known[near], k] if before else table[k, known[near]]) / (table[:, k].sum() if before else table[k].sum())) for k in range(classes)]
                        sums += np.array(each, np.float32) * c
            out[w] = int(np.argmax(sums)) if sums.any() else hashed[w] % classes
        return out

    def table_of(known, own):
        table = np.zeros((classes + 2, classes + 2))
        for (a, b), c in steps.items():
            if a in own and b in own:
                table[known[a], known[b]] += c
        return table

    cls |= placed([w for w in head if w not in core], cls, table_of(cls, {None, *core}) + 0.1)
    table = np.zeros((classes + 2, classes + 2))
    for (a, b), c in steps.items():
        if a in cls and b in cls:
            for x in [cls[a]] + [unknown] * (n[a] == 1):
                for y in [cls[b]] + [unknown] * (n[b] == 1):
                    table[x, y] += c
    every = cls | placed([w for w in n if w not in cls], cls, table + 0.1)
    for (a, b), c in steps.items():
        if not (a in cls and b in cls):
            for x in [every[a]] + [unknown] * (n[a] == 1):
                for y in [every[b]] + [unknown] * (n[b] == 1):
                    table[x, y] += c
    base = (table.sum(axis=0) + 1) / (table.sum() + classes + 2)
    total = Counter()
    for w, c in n.items():
        total[every[w]] += c
    out = []
    for r in rows:
        at = [end] + [every.get(w, unknown) for w in r]
        score = 0.0
        for a, b, w in zip(at, at[1:], r, strict=False):
            score += math.log10((table[a, b] + brown.STRENGTH * base[b]) / (table[a].sum() + brown.STRENGTH)) + (math.log10(n[w] / total[b]) if w in n else 0.0)
        out.append(score)
    return out


@pytest.mark.parametrize(("core", "head"), [(2048, 1 << 20), (6, None), (8, 9)])
def test_base_and_class_scores_equal_brute_force(spark, core, head):
    rng = random.Random(3)
    rows = two_tongues(150) + [(150, None), (151, ""), (152, "Rare ÜNIQUE \x0b rare"), (3, "repeated row"), (None, "null id")]
    rows += [(200 + k, " ".join(f"{a}{rng.randrange(40)}" for a in ("once", "seldom", "x", "once"))) for k in range(30)]
    df = spark.createDataFrame([(*r, True) for r in rows], DOCS + ", held_out boolean").repartition(3)
    got = brown.class_model_scores(df, crc_mod("doc_id", 7) == 2, classes=4, core_words=core, head_words=head, rounds=1).collect()
    assert len(got) == len(rows)
    count: Counter = Counter()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    for d, t in rows:
        if not held(d):
            count.update([*brute.words(t), None])
    n, v = sum(count.values()), len(count)
    scores = plain_class_scores([t for _, t in rows], [not held(d) for d, _ in rows], 4, core, head or 1 << 40)
    want = Counter()
    for (d, t), score in zip(rows, scores, strict=True):
        tokens = [*brute.words(t), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        want[d, held(d), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6), round(score, 4), round(10 ** (-score / len(tokens)), 2)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 4), round(r["perplexity"], 2)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_class_score_of_a_long_text(spark):
    words = " ".join(f"w{k % 700}" for k in range(400_000))
    df = spark.createDataFrame([(1, words), (2, words), (3, "w1 w2 w3")], DOCS)
    got = {r["doc_id"]: r for r in brown.class_model_scores(df, F.col("doc_id") == 2).collect()}
    assert got[2]["n_tokens"] == 400_001 and got[2]["score"] == got[1]["score"] and got[2]["perplexity"] < 701


def test_scores_without_training_rows_or_any_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    got = brown.class_model_scores(df, F.lit(True)).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert brown.class_model_scores(df.where("false"), F.lit(False)).count() == 0


def test_exchange_parts_words_that_alternate():
    rng = np.random.default_rng(0)
    left, right = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 10), rng.integers(10, 20)
        left += [a, b]
        right += [b, a]
    pair, n = np.unique(np.array(left) * 20 + np.array(right), return_counts=True)
    cls = brown.exchange(pair // 20, pair % 20, n.astype(float), 20, classes=2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:])) == 1 and cls[0] != cls[10]


def test_every_distribution_of_the_exchange_keeps_likelihood():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 30, 500), rng.integers(0, 30, 500)
    pair, n = np.unique(left * 30 + right, return_counts=True)

    def likelihood(cls):
        t = np.zeros((5, 5))
        np.add.at(t, (cls[pair // 30], cls[pair % 30]), n)
        f = brown._xlogx
        return f(t).sum() - f(t.sum(axis=0)).sum() - f(t.sum(axis=1)).sum()

    assert likelihood(brown.exchange(pair // 30, pair % 30, n.astype(float), 30, 5)) >= likelihood(np.arange(30) % 5)


SENTENCES = {
    "en": "the weather was fine and they went for a walk in the park with their dog before the rain came",
    "de": "das wetter war schön und sie gingen mit ihrem hund im park spazieren bevor der regen kam",
    "fr": "le temps était beau et ils sont allés se promener dans le parc avec leur chien avant la pluie",
    "es": "el tiempo era bueno y fueron a pasear por el parque con su perro antes de que llegara la lluvia",
}


def test_language_by_text_and_by_context(spark):
    train = spark.createDataFrame([(k, t) for k, t in SENTENCES.items()] * 5 + [("xx", "zzz"), (None, "abc"), ("en", None)], "lang string, text string")
    model = langid.text_model(train)
    rows = [(k, SENTENCES[lang].split(" ", 3)[3], None, None, None) for k, lang in enumerate(SENTENCES)]
    rows += [(10, None, "en", "com", "h"), (11, "", "en", "com", "h"), (12, "123 !!", None, None, None)]
    rows += [(20 + k, SENTENCES["de"], "de", "de", "a.example.de") for k in range(30)] + [(60, "in", "de", "de", "a.example.de"), (61, "in", None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, text string, declared string, suffix string, host string, lang int")
    got = {r["id"]: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(rows)
    assert [got[k]["lang"] for k in range(4)] == list(SENTENCES)
    for k in (10, 11, 12):
        assert got[k]["lang"] == "und" and not got[k]["accepted"]
    assert got[60]["lang"] == "de" and got[60]["accepted"]
    assert langid.identify(df.where("false"), model).count() == 0


def test_every_declared_language_is_learnt_and_unknown_text_is_rejected(spark):
    rng = random.Random(6)

    def text(syllables: list[str], n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    speech = {k: [c + v for c in cs for v in vs] for k, cs, vs in (("aa", "bdg", "ae"), ("bb", "ptk", "io"), ("cc", "mnl", "uy"), ("dd", "szv", "eo"), ("nl", "rhj", "au"), ("zz", "fwx", "iy"))}
    train = spark.createDataFrame([(k, text(v, 60)) for k, v in speech.items() if k != "zz" for _ in range(80)], "lang string, text string")
    model = langid.text_model(train)
    rows = [(k, text(v, 60)) for k, v in enumerate(speech.values())]
    rows += [(10 + k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40))) for k in range(5)]
    rows += [(20 + k, text(speech["nl"], 4)) for k in range(20)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "id bigint, text string, declared string, suffix string, host string")
    got = {r["id"]: r for r in langid.identify(df, model).collect()}
    assert [got[k]["lang"] for k in range(6)] == ["aa", "bb", "cc", "dd", "nl", "und"]
    assert [got[k]["accepted"] for k in range(6)] == [True] * 5 + [False]
    assert not any(got[10 + k]["accepted"] for k in range(5))
    assert all(got[20 + k]["lang"] == "nl" and got[20 + k]["accepted"] for k in range(20))


def test_page_rows(spark):
    pages = [(1, "https://www.a.example.de/de/x?y", "<html LANG='de-AT'><script>the</script><p>Hallo &amp; Welt</p><!-- the -->"), (2, None, None), (3, "nothing", "<p>x")]
    got = {r["id"]: r for r in langid.page_rows(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert (got[1]["declared"], got[1]["suffix"], got[1]["host"]) == ("de", "de/de", "www.a.example.de")
    assert got[1]["text"].split() == ["Hallo", "Welt"]
    assert got[2]["host"] is None and got[2]["text"] is None and got[3]["host"] is None


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(4)
    calm, bad = [f"{a}{b}{c}" for a in "bdgm" for b in "aeo" for c in ("lin", "rat", "sol")], ["zorkig", "zorkent", "zorkisp", "zorkei", "zorkung"]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(calm) for _ in range(rng.randrange(20, 150))]
        if k % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad[:4] if k < 400 else bad)
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    rows += [(600, None), (601, ""), (602, "... !!"), (603, "x" * 40000), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", toxic int")
    scored = toxicity.toxicity_scores(df, spark.createDataFrame([*labels, (None, 1), (9999, 1), (5, None)], "doc_id bigint, toxic int"), crc_mod("doc_id", 4) == 2).collect()
    assert len(scored) == len(rows)
    got = {r["doc_id"]: r for r in scored}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    held = [k for k in range(600) if got[k]["held_out"]]
    assert held and np.mean([got[k]["predicted"] == (k % 5 == 0) for k in held]) > 0.93
    assert got[600]["score"] == got[601]["score"] == got[602]["score"] == 0
    assert toxicity.toxicity_scores(df, spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(False)).count() == len(rows)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = toxicity.Network()
    x, y = rng.normal(size=(6, 4, toxicity.INPUTS)).astype(np.float32), np.array([0, 1, 1, 0], np.float32)
    mask = np.ones((6, 4), np.float32)
    mask[4:, 1] = 0
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss() -> float:
        p = toxicity._sigmoid(net.logits(net.gates(x), mask))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grad = net.gradients(x, mask, y)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        old = value[at]
        value[at] = old + 1e-2
        up = loss()
        value[at] = old - 1e-2
        down = loss()
        value[at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-4), name


PAGES = "page_id bigint, url string, html string"


def plain_parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return brute.lower(host), tail[:stop]


def plain_rule(host: str, path: str) -> tuple[str | None, str | None]:
    fits = [(len(h + p), h + p, v) for v, h, p in linkrank.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_hosts_and_paths(spark):
    urls = [
        "http://Www.Example.COM/en/x?y#z", "http://example.com/en/1", "http://a.example.com/fr/", "http://b.net/es/q", "http://b.net/de/", "http://net/fr/", "com", "http://com/", "http://a.com", "http://a.com?x=/en/",
        "http://www.example.com/en/", "https://x.www.example.com/en/a#b", "http://a.org/en/", "ftp://É.com/É", "://", "http://", "x://y://z/a", None, "", "http://notexample.com/en/",
    ]
    df = spark.createDataFrame([(k, u, None, "h") for k, u in enumerate(urls)], PAGES + ", host string")
    got = {r["page_id"]: r for r in linkrank.judge_urls(df).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == verdict if verdict else got[k]["verdict"] in ("allow", "block")
    assert linkrank.judge_urls(df.where("false")).count() == 0


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    pages = [(1, "http://bad.net/es/", ""), (2, "http://good.com/", '<a href="https://friend.org/">'), (3, "http://farm.info/", '<a href="http://BAD.net/x"> <img src=//bad.net/y>'), (4, "http://friend.org/", None)]
    got = {r["page_id"]: r for r in linkrank.judge_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert got[3]["verdict"] == "block" and got[3]["rule"] is None
    assert got[4]["verdict"] == "allow" and got[4]["trust"] > 0
    scores = linkrank.host_scores(spark.createDataFrame([("bad.net", "/es/", ""), ("a.com", "/", "")], "host string, path string, html string")).collect()
    assert sum(r["trust"] for r in scores) == pytest.approx(1) and sum(r["distrust"] for r in scores) == pytest.approx(1)


def dense_ranks(hosts, edges, seeds):
    """Personalised PageRank by a dense matrix; every host also links to itself."""
    at = {h: k for k, h in enumerate(hosts)}
    m = np.eye(len(hosts))
    for (a, b), n in edges.items():
        m[at[a], at[b]] += n
    m /= m.sum(axis=1, keepdims=True)
    seed = np.array([float(seeds.get(h, 0)) for h in hosts])
    seed /= seed.sum()
    rank = seed.copy()
    for _ in range(400):
        rank = (1 - linkrank.DAMPING) * seed + linkrank.DAMPING * rank @ m
    return dict(zip(hosts, rank, strict=True))


def test_ranks_equal_those_of_a_dense_matrix(spark):
    links = [("a.com", "b.org"), ("a.com", "c.org"), ("b.org", "bad.net"), ("c.org", "a.com"), ("d.info:8080", "bad.net:443"), ("x.y.d.info", "d.info")]
    pages = [(h, "/es/", f'<a HREF = "https://{to}/p"> <img src="http://pic.org/">') for h, to in links] + [("bad.net", "/es/", None), ("e.com", "/", "")]
    got = {r["host"]: r for r in linkrank.host_scores(spark.createDataFrame(pages, "host string, path string, html string"), rounds=90, tolerance=1e-9).collect()}
    plain = lambda h: h.split(":")[0]
    edges = Counter((plain(a), plain(b)) for a, b in links)
    for a, b in (("x.y.d.info", "y.d.info"), ("y.d.info", "d.info")):
        edges[a, b] += 1
        edges[b, a] += 1
    hosts = sorted({h for e in edges for h in e} | {"e.com"})
    assert sorted(got) == hosts
    trust = dense_ranks(hosts, edges, {"a.com": 2, "e.com": 1})
    distrust = dense_ranks(hosts, Counter({(b, a): n for (a, b), n in edges.items()}), {"bad.net": 1})
    for h in hosts:
        assert got[h]["trust"] == pytest.approx(trust[h], abs=1e-6) and got[h]["distrust"] == pytest.approx(distrust[h], abs=1e-6)


def test_ladder_ends_at_domains_that_can_be_registered(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.example.com", "h1.co.uk", "x.h1.co.uk", "10.0.0.1", "example.com", "com", "a.co.com", "")], "host string")
    assert sorted(map(tuple, linkrank.ladder(hosts).collect())) == [("a.b.example.com", "b.example.com"), ("a.co.com", "co.com"), ("b.example.com", "example.com"), ("x.h1.co.uk", "h1.co.uk")]


def test_page_text_has_no_markup_and_long_pages_are_quick(spark):
    pages = [
        (1, "http://a.de/x", "<html lang='DE'><script>var x</script>Hallo<!-- no --><style>p{}</style> <b>Welt</b>&nbsp;!"),
        (2, None, "<" * 300_000),
        (3, "nowhere", "<script " * 50_000 + "text"),
        (4, "http://a.de/fr/x", "<html " * 50_000),
        (5, "http://a.de:8/", None),
    ]
    began = time.perf_counter()
    got = {r["id"]: r for r in langid.page_rows(spark.createDataFrame(pages, PAGES)).collect()}
    assert time.perf_counter() - began < 20
    assert got[1]["text"].split() == ["Hallo", "Welt", "!"] and got[1]["declared"] == "de" and got[1]["host"] == "a.de"
    assert got[4]["suffix"] == "de/fr" and got[5]["text"] is None and got[2]["host"] is None


def plain_posterior(text, declared, suffix, host, rows, model):
    """The posterior of one row by loops, from the guesses of all rows."""

    def evidence(t):
        letters = [c if c.isalpha() else " " for c in (t or "").lower()]
        grams = [letters[k : k + 3] for k in range(len(letters) - 2)]
        grams = [g for g in grams if g.count(" ") <= 1]
        buckets = [langid._trigrams(np.frombuffer("".join(g).encode(), np.uint8), np.array([0, 3]))[0][0] for g in grams]
        if not buckets:
            return np.zeros(len(model.names)), 0
        return np.array([np.mean([logs[b] for b in buckets]) for logs in model.logs]) * langid.TEMPER * np.log1p(len(buckets) / langid.TEMPER), len(buckets)

    k = len(model.names)
    counts = defaultdict(lambda: np.zeros(k))
    for t, d, s, h in rows:
        scores, n = evidence(t)
        if sum(c.isalpha() for c in t or "") >= 10 and n:
            domain = h if h is None or h.count(".") < 2 else h.split(".", 1)[1]
            for key in (("all",), ("d", d), ("s", s), ("h", h), ("domain", domain)):
                counts[key][int(np.argmax(scores))] += 1
    whole = counts["all",] + 1
    shares = lambda seen, prior: (seen + langid.SMOOTHING * prior) / (seen.sum() + langid.SMOOTHING)
    domain = host if host is None or host.count(".") < 2 else host.split(".", 1)[1]
    prior = shares(counts["h", host], shares(counts["domain", domain], whole / whole.sum()))
    ratio = lambda key: np.log((counts[key] + 1) / (whole + 1))
    score = evidence(text)[0] + ratio(("d", declared)) + 0.5 * ratio(("s", suffix)) + np.log(prior)
    p = np.exp(score - score.max())
    return dict(zip(model.names, p / p.sum(), strict=True))


def test_posterior_equals_brute_force(spark):
    rng = random.Random(2)
    train = spark.createDataFrame([(k, t) for k, t in SENTENCES.items()] * 5, "lang string, text string")
    model = langid.text_model(train)
    rows = []
    for k in range(60):
        lang = rng.choice(["en", "de", "fr", "es"])
        own = SENTENCES[lang].replace("ö", "o").replace("é", "e").split()
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randrange(1, 12))), rng.choice([lang, lang, "en", None]), rng.choice([lang, "com", None]), rng.choice([f"{lang}.example.org", "www.a.com", "b.net", None])))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id bigint, text string, declared string, suffix string, host string")
    judged = 0
    for r in langid.identify(df, model).collect():
        if r["lang"] != "und":
            want = plain_posterior(*rows[r["id"]], rows, model)
            assert max(want, key=want.get) == r["lang"] and r["posterior"] == pytest.approx(want[r["lang"]], rel=1e-3)
            judged += 1
    assert judged > 40


def plain_network(network, x):
    """The logit of one window, unit by unit."""
    p = {k: v.astype(float) for k, v in network.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d in "fb":
        h, n = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g, r = x[t] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            z, keep = sigmoid(g[:n] + r[:n]), sigmoid(g[n : 2 * n] + r[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(g[2 * n :] + keep * r[2 * n :])
            states[d, t] = h
    s = [np.concatenate((states["f", t], states["b", t])) for t in range(len(x))]
    weight = np.exp([np.tanh(v @ p["A"]) @ p["a"] for v in s])
    return sum(w * v for w, v in zip(weight / weight.sum(), s, strict=True)) @ p["o"] + p["b"][0] + network.shift


def test_score_of_a_text_is_that_of_its_worst_window_unit_by_unit():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 150))) + (" vile scum" if k % 2 else "") for k in range(60)]
    tables, network = toxicity.fit(texts, [k % 2 for k in range(60)])
    got = next(iter(toxicity._score_rows(pa.array(texts), tables, network)))[1]
    for text, score in zip(texts, got, strict=True):
        buf = np.frombuffer(text.encode(), np.uint8)
        v = toxicity._Vocabulary(buf, np.array([0, len(buf)]))
        x = v.inputs(tables)[v.word].astype(float)
        starts = [0, *(k for k in range(toxicity.STRIDE, len(x), toxicity.STRIDE) if k + toxicity.STEPS - toxicity.STRIDE < len(x))]
        logits = [plain_network(network, x[a : a + toxicity.STEPS]) for a in starts]
        assert score == pytest.approx(1 / (1 + math.exp(-max(logits))), abs=1e-4)


def test_sample_is_bounded_in_texts_and_bytes_and_reruns_agree(spark):
    rows = [(k, f"text {k} " + "x" * 100) for k in range(60)] + [(5, "another text"), (70, "y" * 5000), (None, "z")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(70, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    seen = set()
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, DOCS).repartition(parts)
        texts, marks, _ = toxicity._sampled(docs, labels, F.lit(True), 20, 10, 50_000)
        assert sum(marks) in (19, 20) and len(marks) == sum(marks) + 10 and "y" * 5000 not in texts
        seen.add(tuple(texts))
        assert sum(map(len, toxicity._sampled(docs, labels, F.lit(True), 20, 10, 6000)[0])) <= 6000
    assert len(seen) == 1
