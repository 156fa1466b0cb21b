"""Benchmark decontamination by template windows.

Texts are turned into templates: numbers, names and units become typed placeholders, other words
are lower-cased and lose the punctuation around them (a second template takes names for plain
words, so that capitals alone hide nothing). Windows of eight template tokens, and of six
in items that a changed word would leave with too few of eight, are hashed and joined; the values
in the placeholders of the matched windows must then map consistently, so a question with other
numbers or names is caught and a chance match is not. What counts is half of an item's windows, a
run of matched tokens, or nearly all tokens of an item of few.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stash
from .textkit import mix64

WINDOW = 8
LEAST_TOKENS = 6
LEAST_LITERAL = 0.5
COVERAGE = 0.5
RUN = 13  # so many matched tokens in a row are a passage of the item
EDIT = LEAST_TOKENS  # a changed word and the tokens between it and the near end, too few for a window
FILTER_BITS = 1 << 25
BROADCAST_ROWS = 200_000  # windows of eight values and slots at most, 40 MB

# Units of measure that follow a number.
UNITS = "kg g mg t lb lbs oz km m cm mm mi ft in yd l ml s sec ms min h hr hour hours day days week weeks month months year years usd eur gbp dollars euros cents percent % $ € £ mph kmh w kw v a hz".split()

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th|[a-z]{1,3})?$")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "+-$%") + "“”‘’«»…–—"
_PLAIN, _NUM, _CAPITAL, _UNIT, _STOPS = 0, 1, 2, 4, 8
_rng = np.random.default_rng(404)
_PLACE = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = _rng.integers(1, 2**63, 3, dtype=np.uint64)
_SLOTS = {_NUM: 0, _CAPITAL: 1, _UNIT: 2}


class _Words(dict):
    """Word to index; hash, hash with case, and flags by index. Emptied when it has grown large."""

    def __init__(self) -> None:
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hashes: list[int] = []
        self.flags: list[int] = []

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGE)
        low = bare.lower()
        flag = _NUM if _NUMBER.match(low) else _UNIT if low in _UNIT_SET else _CAPITAL if bare[:1].isupper() else _PLAIN
        if word[-1:] in ".!?:" or word[-2:-1] in ".!?":
            flag |= _STOPS
        self[word] = at = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(low))
        self.flags.append(flag)
        return at


_UNIT_SET = frozenset(UNITS)


_Template = tuple[np.ndarray, np.ndarray, np.ndarray | None, int]  # hash, is a placeholder, needed, and of the needed at least how many


def _templates(texts: list[str | None], words: _Words) -> tuple[np.ndarray, np.ndarray, Callable[[int], list[_Template]]]:
    """Of all tokens of the texts: row, value hash, and the templates for windows of a length.

    The first template holds names as placeholders; in the second, which capitals do not disturb,
    they are plain words, and only windows with a name need it. The third is literal, for windows
    with too many numbers and units for the others; windows under LEAST_TOKENS have no other.
    """
    if len(words) > 300_000:
        words.reset()
    at: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = (text or "").split()
        at += map(words.__getitem__, own)
        sizes[k] = len(own)
    index = np.array(at, np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    value = np.array(words.hashes, np.uint64)[index] if len(index) else np.zeros(0, np.uint64)
    flags = np.array(words.flags, np.int64)[index] if len(index) else np.zeros(0, np.int64)
    opens = np.ones(len(index), bool)  # a capital there is no sign of a name
    after_number = np.zeros(len(index), bool)
    if len(index):
        opens[1:] = (row[1:] != row[:-1]) | (flags[:-1] & _STOPS > 0)
        after_number[1:] = (row[1:] == row[:-1]) & (flags[:-1] & _NUM > 0)
    number, name, unit = flags & _NUM > 0, (flags & _CAPITAL > 0) & ~opens, (flags & _UNIT > 0) & after_number
    plain = value.copy()
    plain[number] = _KIND[_SLOTS[_NUM]]
    plain[unit] = _KIND[_SLOTS[_UNIT]]
    template = plain.copy()
    template[name] = _KIND[_SLOTS[_CAPITAL]]
    values, none = number | unit, np.zeros(len(index), bool)

    def templates(length: int) -> list[_Template]:
        if length < LEAST_TOKENS:
            return [(value, none, None, 0)]
        return [(template, values | name, None, 0), (plain, values, name, 1), (value, none, values, int((1 - LEAST_LITERAL) * length) + 1)]

    return row, value, templates


def _fits(n_tokens: np.ndarray, length: int) -> np.ndarray:
    """Whether an item of so many tokens has windows of this length: eight, six beside them, or all its tokens."""
    if length == WINDOW:
        return n_tokens >= WINDOW
    return (n_tokens == length) | ((length == LEAST_TOKENS) & (n_tokens >= WINDOW) & (n_tokens < 2 * RUN))


def _windows(row: np.ndarray, template: np.ndarray, slot: np.ndarray, needed: np.ndarray | None, least: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the windows of this length that stay within a row, are literal enough and hold the least of needed tokens."""
    n = len(row) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    slots = np.concatenate(([0], np.cumsum(slot)))
    fits = (row[:n] == row[length - 1 :]) & (length - (slots[length:] - slots[:-length]) >= LEAST_LITERAL * length)
    if needed is not None:
        held = np.concatenate(([0], np.cumsum(needed)))
        fits &= held[length:] - held[:-length] >= least
    at = np.flatnonzero(fits)
    rolled = np.full(len(at), length, np.uint64)
    for k in range(length):
        rolled += template[at + k] * _PLACE[k]
    return at, mix64(rolled)


def _firsts(row: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each hash its first place in each row."""
    order = np.lexsort((at, hashes, row[at]))
    own, same = row[at][order], hashes[order]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (same[1:] != same[:-1])
    return np.sort(order[new])


_FOUND = "id bigint, text_key bigint, length int, n_tokens int, pos int, hash bigint, values array<bigint>, slots array<boolean>"


def _found(part: pa.RecordBatch, rows: np.ndarray, sizes: np.ndarray, at: np.ndarray, pos: np.ndarray, hashes: np.ndarray, length: int, value: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    signed = value.view(np.int64)
    return pa.record_batch(
        {
            "id": part.column(0).take(pa.array(rows)),
            "text_key": part.column(2).take(pa.array(rows)),
            "length": pa.array(np.full(len(at), length, np.int32)),
            "n_tokens": pa.array(sizes[rows].astype(np.int32)),
            "pos": pa.array(pos.astype(np.int32)),
            "hash": pa.array(hashes.view(np.int64)),
            "values": pa.array([signed[a : a + length].tolist() for a in at], pa.list_(pa.int64())),
            "slots": pa.array([slot[a : a + length].tolist() for a in at], pa.list_(pa.bool_())),
        }
    )


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            row, value, templates = _templates(part.column(1).to_pylist(), words)
            sizes = np.bincount(row, minlength=part.num_rows)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for length in range(1, WINDOW + 1):
                for template, slot, needed, least in templates(length):
                    at, hashes = _windows(row, template, slot, needed, least, length)
                    fits = _fits(sizes[row[at]], length)
                    at, hashes = at[fits], hashes[fits]
                    yield _found(part, row[at], sizes, at, at - starts[row[at]], hashes, length, value, slot)


def _bits_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (4 MB) of the hashes; it only ever lets too many through."""
    slot = hashes.select((F.pmod("hash", F.lit(FILTER_BITS)) + 1).alias("h"))  # bitmap positions count from 1
    parts = slot.groupBy(F.bitmap_bucket_number("h").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for got in parts.collect():
        at = (got["part"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(got["bits"]), np.uint8)
    return bits


def _joined(windows: Column) -> Column:
    """Of windows (pos, length) by pos: the tokens they cover together, and the longest run of them."""

    def add(state: Column, w: Column) -> Column:
        end = w["pos"] + w["length"]
        on = w["pos"] <= state["end"]
        start, stop = F.when(on, state["start"]).otherwise(w["pos"]), F.greatest(state["end"], end)
        tokens = state["tokens"] + F.greatest(F.lit(0), end - F.greatest(state["end"], w["pos"]))
        return F.struct(start.alias("start"), stop.alias("end"), tokens.alias("tokens"), F.greatest(state["run"], stop - start).alias("run"))

    return F.aggregate(windows, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("tokens"), F.lit(0).alias("run")), add)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, tokens, run, verbatim): the pairs in which docs holds an item.

    docs(doc_id, text), benchmark(item_id, text); other columns are ignored. Windows count unless
    a slot of theirs differs from the item and from what most places of its value became along the
    diagonal. A pair counts if

    * the item's windows that occur in the document are at least ``coverage`` of its windows, or
    * RUN item tokens in a row lie in matched windows of one diagonal, or
    * the item has fewer than 2 * RUN tokens and at most EDIT of them are in no matched window of
      one diagonal, and at least eight are: so one changed word hides no item of 14 tokens or more.

    Items of six or seven tokens are one window; shorter items are one literal window, so only
    capitals and punctuation around words may differ. Null and empty texts on either side and rows
    with a null id match nothing. Texts of any length are read whole. Repeated rows and several
    items with one text each give their pair once; several texts under one id, of documents or of
    items, are compared each by its own, and the pair has the figures of those that match most. ``matched``, ``windows`` and ``coverage`` are of windows of eight
    (or the one window); ``tokens`` and ``run`` are the most on any diagonal.
    """
    spark = docs.sparkSession
    text_key = F.xxhash64("text").alias("text_key")  # texts that share an id stay apart
    items = benchmark.select("item_id", "text", text_key).where("item_id is not null").mapInArrow(_item_windows, _FOUND)
    items = stash(items.dropDuplicates(["id", "text_key", "pos", "hash"]), "item-windows")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most eight
    shared = spark.sparkContext.broadcast(_bits_of(items))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words = shared.value, _Words()
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                row, value, templates = _templates(part.column(1).to_pylist(), words)
                sizes = np.bincount(row, minlength=part.num_rows)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                for length, (template, slot, needed, least) in ((n, t) for n in lengths for t in templates(n)):
                    at, hashes = _windows(row, template, slot, needed, least, length)
                    place = hashes & np.uint64(FILTER_BITS - 1)
                    held = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at, hashes = at[held], hashes[held]
                    if length < LEAST_TOKENS:  # a short item is as good once as many times
                        first_at = _firsts(row, at, hashes)
                        at, hashes = at[first_at], hashes[first_at]
                    if len(at):
                        yield _found(part, row[at], sizes, at, at - starts[row[at]], hashes, length, value, slot)

    found = docs.select("doc_id", "text", text_key).where("doc_id is not null").mapInArrow(hits, _FOUND)
    found = found.select(F.col("id").alias("doc_id"), F.col("text_key").alias("doc_key"), F.col("pos").alias("doc_pos"), "hash", "length", F.col("values").alias("doc_values"))
    known = items.select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "pos", "hash", "length", "n_tokens", "values", "slots")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    texts = ["doc_id", "doc_key", "item_id", "item_key"]
    met = found.join(known, ["hash", "length"]).withColumn("shift", F.col("doc_pos") - F.col("pos"))
    met = stash(met.select(*texts, "shift", "pos", "n_tokens", "length", "values", "doc_values", "slots").distinct(), "met")
    diagonal = [*texts, "shift"]
    filled = met.select(*diagonal, F.posexplode(F.arrays_zip("values", "doc_values", "slots")).alias("k", "x"), "pos").where("x.slots")
    filled = filled.select(*diagonal, (F.col("pos") + F.col("k")).alias("token"), F.col("x.values").alias("value"), F.col("x.doc_values").alias("doc_value")).distinct()
    counted = filled.groupBy(*diagonal, "value", "doc_value").agg(F.count("*").alias("n"))
    several = counted.groupBy(*diagonal, "value").agg(F.collect_list(F.struct("doc_value", "n")).alias("took"), F.sum("n").alias("all")).where(F.size("took") > 1)
    # what most of the value's places became, or what stayed the value itself, is consistent
    several = several.withColumn("took", F.filter("took", lambda x: (2 * x["n"] <= F.col("all")) & (x["doc_value"] != F.col("value"))))
    odd = several.groupBy(*diagonal).agg(F.flatten(F.collect_list(F.transform("took", lambda x: F.struct(F.col("value"), x["doc_value"].alias("doc_value"))))).alias("odd"))
    filling = F.arrays_zip("values", "doc_values", "slots")
    wrong = F.exists(filling, lambda x: x["slots"] & F.array_contains("odd", F.struct(x["values"].alias("value"), x["doc_values"].alias("doc_value"))))
    sure = met.join(odd, diagonal, "left").where(F.col("odd").isNull() | ~wrong)
    same = F.col("values") == F.col("doc_values")
    window = F.struct("pos", "length")
    main = F.col("length") == F.least("n_tokens", F.lit(WINDOW))
    diagonals = sure.groupBy(*diagonal, "n_tokens").agg(
        F.collect_set(window).alias("held"), F.collect_set(F.when(same, window)).alias("equal"), F.collect_set(F.when(main, F.col("pos"))).alias("main")
    )
    joined = _joined(F.array_sort("held"))
    pairs = diagonals.withColumn("joined", joined).groupBy(*texts, "n_tokens").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("main")))).alias("matched"),
        F.max("joined.tokens").alias("tokens"),
        F.max("joined.run").alias("run"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("held")))) == F.size(F.array_distinct(F.flatten(F.collect_list("equal"))))).alias("verbatim"),
    )
    total = items.where(main).groupBy(F.col("id").alias("item_id"), F.col("text_key").alias("item_key")).agg(F.countDistinct("pos").alias("windows"))
    out = pairs.join(total, ["item_id", "item_key"], "left").withColumn("windows", F.coalesce("windows", F.lit(0))).withColumn("coverage", F.when(F.col("windows") > 0, F.col("matched") / F.col("windows")).otherwise(0.0))
    few = (F.col("n_tokens") < 2 * RUN) & (F.col("tokens") >= F.greatest(F.lit(WINDOW), F.col("n_tokens") - EDIT))
    out = out.where((F.col("coverage") >= coverage) | (F.col("run") >= RUN) | few)
    most = F.max(F.struct("tokens", "run", "matched", "coverage", "windows", "verbatim")).alias("most")
    return out.groupBy("doc_id", "item_id").agg(most).select("doc_id", "item_id", *[f"most.{c}" for c in ("matched", "windows", "coverage", "tokens", "run", "verbatim")])
