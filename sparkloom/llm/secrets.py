"""Secret scan: fixed patterns, and a guess-cost dynamic program over values in a credential context."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from heapq import heappop, heappush
from itertools import accumulate
from math import inf, lgamma, log, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stash

# The base patterns and the least length of each match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters or more
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

# Words near which a value is a credential (at the start of a part of a name, as in DB_PWD and dbPin; the
# words of ASSIGN anywhere), a cheap test for them, and words common in passwords.
CONTEXT = re.compile(
    r"""(?:password|passwd|secret|token|api_?key|(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|bearer|credentials?|login))["']?\x20*(?::|=|->|\bis\b)\x20*["'`]?([^\s"'`<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "auth", "bearer", "credential", "login")
COMMON_WORDS = (
    "password pass admin welcome letmein login master dragon monkey shadow sunshine princess football baseball iloveyou "
    "trustno superman batman michael jordan hunter killer soccer hockey ranger george thomas robert daniel andrew joshua "
    "charlie summer winter spring autumn monday friday secret server access system oracle test user guest root default "
    "change changeme freedom whatever ginger flower purple orange yellow silver golden computer internet cookie cheese "
    "january february march april may june july august september october november december love money happy star black "
    "blue green white red the and for you with from this that have name home house office company"
).split()
KEYBOARD_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_LEET = str.maketrans("@4301!57$", "aaeoiists")
_DATE = re.compile(r"(?:(?P<y>19\d\d|20\d\d)(?P<s>[-/._]?)(?P<m>\d\d?)(?P=s)(?P<d>\d\d?)|(?P<d2>\d\d?)(?P<t>[-/._]?)(?P<m2>\d\d?)(?P=t)(?P<y2>19\d\d|20\d\d))")
_YEAR = re.compile(r"(?:19|20)\d\d")
LONGEST_WORD = 24
RANKED = 20_000  # words of the corpus that count as guessable, 1 MB when broadcast
LEAST_COST = 9.0
KIND_COST = log10(6)  # the choice between six kinds of segment
_near: dict[str, set[str]] = {}
for _r, _row in enumerate(KEYBOARD_ROWS):
    for _k, _c in enumerate(_row):
        _near[_c] = {o[j] for o in KEYBOARD_ROWS[max(0, _r - 1) : _r + 2] for j in (_k - 1, _k, _k + 1) if 0 <= j < len(o)} - {_c}


def _char_cost(c: str) -> float:
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log10(26)
    return log10(33) if ord(c) < 128 else 2.0


def _is_date(m: re.Match) -> bool:
    y, mo, d = (int(m["y"]), int(m["m"]), int(m["d"])) if m["y"] else (int(m["y2"]), int(m["m2"]), int(m["d2"]))
    try:
        date(y, mo, d)
    except ValueError:
        return False
    return True


class _Runs:
    """Ends of the runs of one kind; a run that was followed once is not followed again."""

    def __init__(self, goes_on: Callable[[int], bool], n: int) -> None:
        self.goes_on, self.n, self.end = goes_on, n, 0

    def end_from(self, i: int) -> int:
        """The end of the run that holds i; i never decreases."""
        if i >= self.end - 1:
            self.end = i + 1
            while self.end < self.n and self.goes_on(self.end):
                self.end += 1
        return self.end


class _Value:
    """A value and the segments that can start at a position of it."""

    def __init__(self, value: str, ranks: dict[str, int]) -> None:
        low = value.lower()
        if len(low) != len(value):  # a character whose lower case is longer
            low = "".join(c.lower()[0] for c in value)
        self.value, self.low, self.plain, self.ranks = value, low, low.translate(_LEET), ranks
        rises = lambda k: ord(low[k]) > ord(low[k - 1])
        self.same = _Runs(lambda k: low[k] == low[k - 1], len(low))
        self.up, self.down = (_Runs(lambda k, d=d: low[k].isalnum() and ord(low[k]) - ord(low[k - 1]) == d, len(low)) for d in (1, -1))
        self.turns: list[int] = []  # where a walk changes direction

        def walks(k: int) -> bool:
            on = low[k] in _near.get(low[k - 1], ())
            if on and k >= 2 and rises(k) != rises(k - 1) and (not self.turns or self.turns[-1] < k):
                self.turns.append(k)
            return on

        self.walk = _Runs(walks, len(low))

    def segments(self, i: int) -> Iterator[tuple[int, float]]:
        """(end, cost) of the words, dates, years and runs (each to its end) that start at i."""
        low, plain = self.low, self.plain
        if (end := self.same.end_from(i)) - i >= 3:
            yield end, _char_cost(low[i]) + log10(end - i)
        for run in (self.up, self.down):
            if (end := run.end_from(i)) - i >= 3:
                yield end, log10(72) + log10(end - i)
        if (end := self.walk.end_from(i)) - i >= 4:
            turns = bisect_left(self.turns, end) - bisect_left(self.turns, i + 2)
            yield end, log10(47) + log10(end - i) + (turns + 1) * log10(4)
        if "0" <= low[i] <= "9":
            if (m := _DATE.match(low, i)) and _is_date(m):
                yield m.end(), log10(365 * 120) + (log10(5) if m["s"] or m["t"] else 0)
            if _YEAR.match(low, i):
                yield i + 4, log10(120)
        for j in range(i + 3, min(len(low), i + LONGEST_WORD) + 1):
            rank = self.ranks.get(low[i:j])
            swapped = rank is None
            if swapped:
                rank = self.ranks.get(plain[i:j])
            if rank is not None:
                ups = sum(a != b for a, b in zip(self.value[i:j], low[i:j], strict=True))
                odd = 0.0 if not ups else log10(2) if ups in (1, j - i) else (lgamma(j - i + 1) - lgamma(ups + 1) - lgamma(j - i - ups + 1)) / log(10)
                yield j, log10(rank + 1) + odd + swapped * log10(4)


def guess_cost(value: str, ranks: dict[str, int] | None = None, stop: float = inf) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs; inf if it needs 10 ** stop or more.

    Segments are dictionary words (rank, with case and substitution variants), dates and years,
    repeats of a character, alphabet or digit runs, keyboard walks, and brute-force spans. Every
    segment also costs the choice of its kind. An empty value costs 0. Runs are followed once, and
    only positions that cost less than ``stop`` are looked at, so the time is linear in the length.
    """
    own = _Value(value, _RANKS if ranks is None else ranks)
    n = len(value)
    best, brute = {0: 0.0}, {}  # by position: the least cost, and the least that ends in a brute-force span
    todo = [0]

    def offer(costs: dict[int, float], j: int, cost: float) -> None:
        if cost < stop and cost < costs.get(j, inf):
            if j not in best and j not in brute:
                heappush(todo, j)
            costs[j] = cost

    while todo:
        i = heappop(todo)
        so_far = min(best.pop(i, inf), brute.get(i, inf))
        if i == n:
            return so_far
        offer(brute, i + 1, min(so_far + KIND_COST, brute.pop(i, inf)) + _char_cost(value[i]))
        for j, cost in own.segments(i):
            offer(best, j, so_far + KIND_COST + cost)
    return inf


_RANKS = {w: k + 1 for k, w in enumerate(COMMON_WORDS)}


def find_spans(text: str, least_cost: float = LEAST_COST, ranks: dict[str, int] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) as (kind, start, end), end exclusive, by start and then kind as listed."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if ":" in text or "=" in text else []
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base.sort(key=order)
    added = []
    low = text.lower()
    if any(h in low for h in HINTS):
        starts, ends = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max))
        furthest = lambda k: ends[k - 1] if k else -1
        for m in CONTEXT.finditer(text):
            a = m.start(1)
            value = m[1].rstrip(".!?)]}:")
            b = a + len(value)
            if len(value) < 6 or furthest(bisect_right(starts, a)) >= b:
                continue
            # of a value that a base span covers in part, the rest is secret too
            if furthest(bisect_left(starts, b)) > a or guess_cost(value, ranks, least_cost) >= least_cost:
                added.append(("guess", a, b))
    return base, added


HELD_WORDS = 50_000  # distinct words that a task counts before it hands them on


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def drain() -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if 3 <= len(w) <= LONGEST_WORD and w.isalpha()]
        counts.clear()
        return pa.record_batch({"word": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    for batch in batches:
        for _, text in _texts(batch, 0):
            low = text.lower()
            if any(h in low for h in HINTS):
                low = CONTEXT.sub(" ", text).lower()
            counts.update(low.split())
            if len(counts) > HELD_WORDS:
                yield drain()
    yield drain()


def _first_words(counts: DataFrame, most: int) -> list[str]:
    """The ``most`` words of counts(word, n) of highest n, ties by code point.

    A top-k of Spark sends k rows of every task to the driver. Here the words are laid out in ranges
    of that order, and only ranges that begin within the first ``most`` are read again, so the
    driver gets the number of words of each range, and not much more than ``most`` words.
    """
    ranged = counts.repartitionByRange(F.desc("n"), F.col("word")).withColumn("part", F.spark_partition_id())
    ranged = stash(ranged, "ranged-words")
    last = before = 0
    for part, rows in ranged.groupBy("part").count().orderBy("part").collect():
        if before >= most:
            break
        last, before = part, before + rows
    return [r["word"] for r in ranged.where(F.col("part") <= last).orderBy(F.desc("n"), "word").limit(most).select("word").collect()]


def word_ranks(docs: DataFrame, most: int = RANKED) -> dict[str, int]:
    """Ranks of the common words, and after them of the ``most`` words of letters that docs(text) holds most often.

    Words are counted over all rows; what stands where a credential is expected is not counted, so
    that a password in many copies is not taken for a word. Ties go by code point. Only the
    ``most`` words, and a part of a range of them, reach the driver.
    """
    counts = docs.select("text").mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    learnt = _first_words(stash(counts.where("n > 1"), "word-counts"), most)
    return _RANKS | {w: len(_RANKS) + k + 1 for k, w in enumerate(w for w in learnt if w not in _RANKS)}


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, str]]:
    for first in range(0, batch.num_rows, 256):
        for k, text in enumerate(batch.column(at).slice(first, 256).to_pylist()):
            yield first + k, text or ""


def scan_secrets(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """doc_id, counts of the base kinds, base spans and all spans, for every row of docs(doc_id, text).

    The whole text is scanned, whatever its length; null is empty and has no spans. Repeated rows
    get equal answers, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            bases, alls = [], []
            for _, text in _texts(batch, 1):
                base, added = find_spans(text, least_cost, shared.value)
                for kind, found in counts.items():
                    found.append(sum(k == kind for k, _, _ in base + added))
                bases.append(joined(base))
                alls.append(joined(sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))))
            yield pa.record_batch(
                {"doc_id": batch.column(0)}
                | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
                | {"base_spans": pa.array(bases, pa.string()), "spans": pa.array(alls, pa.string())}
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_spans string, spans string")


SLICE_ROWS = 1_000  # rows that are redacted and handed back at once


def redact_secrets(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """docs with every span, overlapping ones merged, replaced by a mark; n_chars follows the text.

    Rows without a secret, null texts among them, stay as they are, and so do all other columns.
    """
    schema, names = docs.schema, docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE_ROWS) for whole in batches for k in range(0, whole.num_rows, SLICE_ROWS)):
            texts: list[str | None] = []
            for k, text in _texts(batch, at):
                base, added = find_spans(text, least_cost, shared.value)
                out, last = [], 0
                for _, a, b in sorted(base + added, key=lambda x: (x[1], -x[2])):
                    if a >= last:
                        out += [text[last:a], "[SECRET]"]
                    last = max(last, b)
                texts.append("".join(out) + text[last:] if out else batch.column(at)[k].as_py())
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = stash(docs.mapInArrow(redact, schema), "redacted")  # in small batches, whatever the caller's own
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(schema["n_chars"].dataType))) if "n_chars" in names else out
