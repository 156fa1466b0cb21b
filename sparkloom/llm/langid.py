"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: naive Bayes over hashed letter trigrams, counted on all rows that declare a language, for
  every language declared. A text that its language explains hardly better than chance is unknown.
* Declared markup language, and address suffix: how often each value goes with each language, by
  grouped aggregation over all rows, with the texts' own best guesses as weak labels.
* Host: shares of languages per host, smoothed towards those of its parent domain, and those
  towards the shares of all rows.
The log probabilities are added; the text's are tempered, as neighbouring trigrams are not independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stash
from .textkit import text_chunks

BUCKETS = 1 << 14
TEMPER = 40.0  # a long text weighs as much as about so many independent trigrams
SMOOTHING = 20.0
FLOOR = 0.2  # of the way from chance to the own texts' mean log likelihood
SLACK = 2.0  # standard errors of the mean below that
HELD = 64  # languages counted at once in a task
CHUNK_BYTES = 1 << 18  # texts cut into trigrams at once, or one longer text

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each letter trigram with at most one space, and its row."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _LETTER[buf]
    gap = b == 32
    ok = ~(gap[:-2] & gap[1:-1]) & ~(gap[1:-1] & gap[2:]) & ~(gap[:-2] & gap[2:])
    inner = offsets[1:-1]
    for back in (1, 2):  # those that reach into the next row
        cut = inner - back
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    at = np.flatnonzero(ok)
    code = b[at].astype(np.uint32) * np.uint32(0x9E3779B1) + b[at + 1].astype(np.uint32) * np.uint32(0x85EBCA6B) + b[at + 2].astype(np.uint32) * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    return (code % np.uint32(BUCKETS)).astype(np.int64), np.searchsorted(offsets, at, "right") - 1


class TextModel(NamedTuple):
    """By language: its name, log probability by trigram bucket, and mean and deviation of that over its own texts."""

    names: list[str]
    logs: np.ndarray
    own: np.ndarray
    spread: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def counts() -> Iterator[pa.RecordBatch]:
        for name, total in totals.items():
            bucket = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([name] * len(bucket), pa.string()), "bucket": pa.array(bucket, pa.int64()), "n": pa.array(total[bucket])})
        totals.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for first, end, buf, offsets in text_chunks(batch.column(1), lower=False, limit=CHUNK_BYTES):
            bucket, row = _trigrams(buf, offsets)
            own = langs[first:end]
            for name in set(own):
                total = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                total += np.bincount(bucket[(own == name)[row]], minlength=BUCKETS)
                if len(totals) >= HELD:
                    yield from counts()
    yield from counts()


def text_model(labelled: DataFrame) -> TextModel:
    """Log probability of each trigram bucket in each declared language, from labelled(lang, text).

    Rows without a language or text are left out, and languages without a trigram. The table has
    the size of the languages times 16384 and is summed before it is sent to the driver.
    """
    known = labelled.where((F.col("lang") != "") & F.col("text").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(_counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stash(counts, "trigrams")
    seen: dict[str, np.ndarray] = {}
    for row in counts.toLocalIterator():
        seen.setdefault(row["lang"], np.zeros(BUCKETS))[row["bucket"]] = row["n"]
    names = sorted(seen) or ["und"]
    table = np.stack([seen.get(x, np.zeros(BUCKETS)) for x in names])
    logs = np.log((table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True))
    share = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
    own = (share * logs).sum(axis=1)
    return TextModel(names, logs, own, np.sqrt((share * (logs - own[:, None]) ** 2).sum(axis=1)))


def _text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    """Adds by language ``evidence``, the tempered log likelihood, and ``fits``, that it explains the text; and ``letters``, their number in bytes; drops text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.logs.astype(np.float32))
    chance = -np.log(BUCKETS)
    floor, slack = chance + FLOOR * (model.own - chance), SLACK * model.spread
    names = [c for c in rows.columns if c != "text"]
    at = rows.columns.index("text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for first, end, buf, offsets in text_chunks(batch.column(at), lower=False, limit=CHUNK_BYTES):
                bucket, row = _trigrams(buf, offsets)
                n = np.bincount(row, minlength=end - first)
                sums = np.stack([np.bincount(row, weights=t[bucket], minlength=end - first) for t in table], axis=1)
                mean = sums / np.maximum(n, 1)[:, None]
                evidence = mean * (TEMPER * np.log1p(n / TEMPER))[:, None]
                fits = (n == 0)[:, None] | (mean >= floor - slack / np.sqrt(np.maximum(n, 1))[:, None])
                letters = np.diff(np.concatenate(([0], np.cumsum(_LETTER[buf] != 32)))[offsets])
                own = {c: batch.column(c).slice(first, end - first) for c in names}
                yield pa.record_batch(own | {"evidence": pa.array(evidence.tolist(), pa.list_(pa.float64())), "fits": pa.array(fits.tolist(), pa.list_(pa.bool_())), "letters": pa.array(letters, pa.int64())})

    return rows.mapInArrow(score, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", evidence array<double>, fits array<boolean>, letters bigint")


def _best(c: Column) -> Column:
    return F.array_position(c, F.array_max(c)) - 1


def _shares(key: str, prior: str, strength: float = SMOOTHING) -> Column:
    """Counts per language smoothed towards a vector of prior shares."""
    total = F.aggregate(F.col(key), F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(key, prior, lambda n, p: (n + strength * p) / (total + strength))


def _counts(rows: DataFrame, n_langs: int, *keys: str) -> DataFrame:
    each = [F.sum(F.element_at("seen", k + 1)).alias(f"n{k}") for k in range(n_langs)]
    return rows.groupBy(*keys).agg(*each).select(*keys, F.array(*[f"n{k}" for k in range(n_langs)]).alias("seen"))


def identify(rows: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """rows(id, text, declared, suffix, host) with lang, posterior, letters, accepted; without text.

    Any of the columns may be null: a null declared, suffix or host is a value of its own, shared
    by all rows that lack it. A text without letters, null and empty ones among them, has lang
    'und', posterior 0 and is not accepted, and so has a text that the best language does not
    explain; other rows are accepted if the best posterior is at least ``least``. A tie goes to
    the language first by name. Texts of any length are read whole. Rows that repeat, or repeat an id
    with another text, are judged each by its own; other columns are ignored. An empty table gives
    no rows.
    """
    n_langs = len(model.names)
    scored = stash(_text_scores(rows.select("id", "text", "declared", "suffix", "host"), model), "language-scores")
    guess = _best(F.col("evidence"))
    # the rows of one context (declared, suffix, host) come down to one; all else is computed on contexts
    seen = scored.where((F.col("letters") >= 10) & F.get("fits", guess.cast("int"))).groupBy("declared", "suffix", "host", guess.alias("guess")).agg(F.count("*").cast("double").alias("n"))
    one = seen.withColumn("seen", F.array(*[F.when(F.col("guess") == k, F.col("n")).otherwise(0.0) for k in range(n_langs)]))
    contexts = stash(_counts(one, n_langs, "declared", "suffix", "host"), "contexts")
    parent = F.when(F.size(F.split("host", r"\.")) > 2, F.expr("substring(host, instr(host, '.') + 1)")).otherwise(F.col("host"))
    contexts = contexts.withColumn("domain", parent)

    whole = contexts.agg(*[F.sum(F.element_at("seen", k + 1)) for k in range(n_langs)]).head()
    whole = [float(x or 0.0) + 1.0 for x in whole]
    shares = [x / sum(whole) for x in whole]
    prior = F.array(*[F.lit(x) for x in shares])

    domains = _counts(contexts, n_langs, "domain").withColumn("base", prior).select(F.col("domain").alias("_domain"), _shares("seen", "base").alias("domain_shares"))
    hosts = _counts(contexts, n_langs, "host", "domain").join(domains, F.col("domain").eqNullSafe(F.col("_domain")))
    hosts = hosts.select(F.col("host").alias("_host"), _shares("seen", "domain_shares").alias("host_shares"))

    def reliability(key: str) -> DataFrame:
        """log P(value | language) but for a term that is the same for all values."""
        counted = _counts(contexts, n_langs, key)
        ratio = F.transform(F.sequence(F.lit(1), F.lit(n_langs)), lambda k: F.log((F.element_at("seen", k) + 1.0) / F.element_at(F.array(*[F.lit(x + 1.0) for x in whole]), k)))
        return counted.select(F.col(key).alias(f"_{key}"), ratio.alias(f"{key}_evidence"))

    declared, suffix = reliability("declared"), reliability("suffix")
    flat = F.array(*[F.lit(0.0)] * n_langs)
    keys = scored.select("declared", "suffix", "host").distinct()
    known = keys.join(declared, keys["declared"].eqNullSafe(declared["_declared"]), "left").join(suffix, keys["suffix"].eqNullSafe(suffix["_suffix"]), "left").join(hosts, keys["host"].eqNullSafe(hosts["_host"]), "left")
    context = F.transform(
        F.sequence(F.lit(1), F.lit(n_langs)),
        lambda k: F.element_at(F.coalesce("declared_evidence", flat), k) + 0.5 * F.element_at(F.coalesce("suffix_evidence", flat), k) + F.log(F.element_at(F.coalesce("host_shares", prior), k)),
    )
    known = stash(known.select(F.col("declared").alias("_declared"), F.col("suffix").alias("_suffix"), F.col("host").alias("_host"), context.alias("context")), "context-evidence")

    on = scored["declared"].eqNullSafe(known["_declared"]) & scored["suffix"].eqNullSafe(known["_suffix"]) & scored["host"].eqNullSafe(known["_host"])
    fused = scored.join(known, on, "left").withColumn("score", F.zip_with("evidence", F.coalesce("context", flat), lambda a, b: a + b))
    top = F.array_max("score")
    mass = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    best = _best(F.col("score")).cast("int")
    known_text = (F.col("letters") > 0) & F.get("fits", best)
    lang = F.when(known_text, F.get(F.array(*[F.lit(x) for x in model.names]), best)).otherwise("und")
    posterior = F.when(known_text, 1.0 / mass).otherwise(0.0)
    out = fused.select("id", "declared", "suffix", "host", "letters", lang.alias("lang"), posterior.alias("posterior"))
    return out.withColumn("accepted", F.col("posterior") >= least)


def page_rows(pages: DataFrame) -> DataFrame:
    """(id, text, declared, suffix, host) of pages(page_id, url, html), for identify(); a row for each row.

    Null, empty and malformed addresses have no host and suffix, a null page no text. The patterns
    are linear in the page: pieces are cut at each opening of a script, style or comment, and of
    each piece the part up to its own end goes; an opening without an end in its piece is text.
    """
    address = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end")
    host = F.lower(F.regexp_extract(address, r"^[^/?#:]*", 0))
    section = F.lower(F.regexp_extract(address, r"^[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    pieces = F.split("html", r"(?i)(?=<script\b|<style\b|<!--)")
    shown = F.transform(pieces, lambda x: F.regexp_replace(x, r"(?is)\A(?:<script\b.*?</script\s*+>|<style\b.*?</style\s*+>|<!--.*?-->)", " "))
    text = F.regexp_replace(F.array_join(shown, ""), r"<[^<>]*+>|&[a-z]{1,31};", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^<>]*\blang=[\"']?([A-Za-z]+)", 1))
    return pages.select(
        F.col("page_id").alias("id"),
        text.alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"),
        F.concat_ws("/", F.substring_index(host, ".", -1), F.nullif(section, F.lit(""))).alias("suffix"),
        F.nullif(host, F.lit("")).alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """(id, text, declared, suffix, host) of docs(doc_id, text, lang, source): a document's source is its host, and it has no address. A row for each row."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
