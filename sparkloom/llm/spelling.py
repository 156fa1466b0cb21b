"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

One edit leaves one half of a word intact. With m the longer word's length, a pair therefore shares
the first part of the word or its last, and both orders of the dictionary are cut into blocks of
words with such a part in common. A block is (m, a, c, affix): its words have length m or m - 1 and
share their first a and last c letters, and the edit lies in what is between. Blocks of more than
BLOCK words are subdivided by the same rule: one half of what is between is intact as well. This
ends, at the latest, with a block of words that differ at one place only, which the alphabet
bounds. A pair belongs to the one block in whose middle its first difference lies, so no pair is
found twice and none is lost.

Blocks are dealt over the cluster by their keys, sorted, and scanned in streams: small blocks are
verified pair by pair on the whole words, large ones handed to the next round. Blocks that hold very
many words are subdivided before they are dealt, so no task gets all of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower, hot_keys, split_join, stash

LETTER = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variant.
TIMES = 5
#: One run in so many, by the crc32 of document and run, loses a letter.
DAMAGED = 199

#: Most words of a block that are compared pair by pair; what differs at one place only is bounded by the alphabet.
BLOCK = 48
_CELLS = 1 << 22

FOUND = "key string, word string, n bigint, near string, near_n bigint"


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word, n: the letter runs of the whole texts with A-Z lower-cased and one run in ``damaged`` a letter short.

    A null id counts as the empty text, a null text has no runs. Counted in Spark before any shuffle.
    """
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    short = F.concat(F.expr("substring(run, 1, int(h % length(run)))"), F.expr("substring(run, int(h % length(run)) + 2)"))
    made = runs.withColumn("h", h).select(F.when(F.col("h") % damaged == 0, short).otherwise(F.col("run")).alias("word"))
    return made.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key(m: Column, a: Column, c: Column) -> Column:
    """Length, parts and the affix itself; the first part comes first, so keys sort as the dictionary does."""
    last = F.when(c > 0, F.right("word", c)).otherwise("")
    return F.concat_ws(" ", m.cast("string"), a.cast("string"), c.cast("string"), F.left("word", a), last)


def _halved(rows: DataFrame) -> DataFrame:
    """word, n, m, a, c: each row in the two blocks into which its own is subdivided."""
    half = F.expr("int((m - a - c) / 2)")
    child = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("c").alias("c")), F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - half).alias("c"))))
    return rows.select("word", "n", "m", child.alias("x")).select("word", "n", "m", F.col("x.a").alias("a"), F.col("x.c").alias("c"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _key(F.col("m"), F.col("a"), F.col("c")))


def _letters(words_: list[str], right: bool, width: int) -> np.ndarray:
    """Code points, one row a word, padded with zeros on the right or the left."""
    padded = [w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words_]
    return np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).reshape(len(padded), width)


def _pairs(words_: list[str], run: np.ndarray, longest: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a run that are one edit apart, of the longest length, the first difference in low..high-1."""
    sizes = np.fromiter(map(len, words_), np.int64, len(words_))
    width = int(sizes.max(initial=0)) + 1
    if len(words_) * width > _CELLS and len(cuts := np.flatnonzero(run[1:] != run[:-1]) + 1):
        cut = int(cuts[len(cuts) // 2])  # a few very long words must not widen the others' rows
        parts = [(_pairs(words_[s], run[s] - run[s][0], longest[s], low[s], high[s]), s.start or 0) for s in (slice(cut), slice(cut, None))]
        return tuple(np.concatenate([found[k] + start for found, start in parts]) for k in (0, 1))
    forward, backward = _letters(words_, False, width), _letters(words_, True, width)
    left, right = [], []
    most = int(np.bincount(run).max(initial=0)) if len(run) else 0
    for gap in range(1, most):
        i = np.flatnonzero(run[:-gap] == run[gap:])
        for i in np.array_split(i, max(1, len(i) * width // _CELLS)):  # noqa: PLW2901
            j = i + gap
            first = (forward[i] != forward[j]).argmax(1)
            last = (backward[i, ::-1] != backward[j, ::-1]).argmax(1)
            small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            same = np.where(small == large, first + last == large - 1, (large == small + 1) & (np.minimum(first, small) + np.minimum(last, small) >= small))
            good = same & (large == longest[i]) & (first >= low[i]) & (first < high[i])
            left.append(i[good])
            right.append(j[good])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _scan(block: int):  # noqa: ANN202
    """Verify the small blocks of sorted rows (key, m, a, c, word, n), hand on the large ones."""
    schema = pa.schema([("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def verified(part: pa.Table) -> tuple[pa.RecordBatch | None, list[int]]:
        key = part.column("key").combine_chunks()
        cut = np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)])
        run = np.cumsum(cut) - 1
        size = np.bincount(run)
        m, a, c = (part.column(x).to_numpy() for x in ("m", "a", "c"))
        open_ = (size[run] > block) & (m - a - c > 1)
        kept = np.flatnonzero(~open_)
        out = None
        if len(kept):
            rows = part.take(pa.array(kept))
            names, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
            i, j = _pairs(names, np.unique(run[kept], return_inverse=True)[1], m[kept], a[kept], (m - c)[kept])
            word = rows.column("word").combine_chunks()
            x, y = np.concatenate([i, j]), np.concatenate([j, i])
            out = pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.string()), word.take(pa.array(x)), pa.array(n[x]), word.take(pa.array(y)), pa.array(n[y])], schema=schema)
        return out, np.flatnonzero(open_)

    def handed_on(part: pa.Table) -> pa.RecordBatch:
        key, nulls = part.column("key").combine_chunks(), part.num_rows
        return pa.RecordBatch.from_arrays([key, part.column("word").combine_chunks(), part.column("n").combine_chunks(), pa.nulls(nulls, pa.string()), pa.nulls(nulls, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last block seen, which may go on
        large = None  # key of a block that is handed on as it streams by
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([held, part]) if held is not None else part
            held = None
            if not part.num_rows:
                continue
            last = part.column("key")[part.num_rows - 1]
            first_of_last = pc.index(part.column("key").combine_chunks(), last).as_py()
            tail, part = part.slice(first_of_last), part.slice(0, first_of_last)
            if part.num_rows and large is not None and part.column("key")[0].as_py() == large:
                rest = pc.sum(pc.equal(part.column("key"), large)).as_py()
                yield handed_on(part.slice(0, rest))
                part = part.slice(rest)
            if part.num_rows:
                large = None
                out, rest = verified(part)
                if out is not None:
                    yield out
                if len(rest):
                    yield handed_on(part.take(pa.array(rest)))
            row = tail.slice(0, 1)
            middle = row.column("m")[0].as_py() - row.column("a")[0].as_py() - row.column("c")[0].as_py()
            if last.as_py() == large or tail.num_rows > block and middle > 1:
                large = last.as_py()
                yield handed_on(tail)
            else:
                large = None
                held = tail
        if held is not None and held.num_rows:
            out, rest = verified(held)
            if out is not None:
                yield out
            if len(rest):
                yield handed_on(held.take(pa.array(rest)))

    return run


def near_pairs(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: every pair of distinct words of counted(word, n) one edit apart, both ways round.

    counted holds each word once, without null; words of one letter or none are not looked at.
    """
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    whole = counted.where(F.length("word") > 1).select("word", "n", lengths).withColumns({"a": F.lit(0), "c": F.lit(0)})
    open_, found = _keyed(_halved(whole)), []
    while True:
        open_ = stash(open_, "blocks")
        hot = [k for k, _ in hot_keys(open_, "key")]
        parts = F.split("key", " ")
        if hot:
            keys = F.broadcast(open_.sparkSession.createDataFrame([(k,) for k in hot], "key string"))
            wide = open_.where("m - a - c > 1").join(keys, "key", "left_semi")
            again = _keyed(_halved(wide))
            rest = open_.join(keys.withColumn("hot", F.lit(True)), "key", "left").where("hot is null or m - a - c <= 1").drop("hot")
        else:
            again, rest = None, open_
        dealt = rest.select("key", "m", "a", "c", "word", "n").repartition("key").sortWithinPartitions("key", "word")
        scanned = stash(dealt.mapInArrow(_scan(block), FOUND), "near")
        found.append(scanned.where("near is not null").drop("key"))
        left = scanned.where("near is null").select("word", "n", *(parts[k].cast("int").alias(x) for k, x in enumerate("mac")))
        if again is None and left.isEmpty():
            break
        open_ = _keyed(_halved(left))
        open_ = open_.unionByName(again.select(open_.columns)) if again is not None else open_
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: from forms(word, form) to the last, by doubling; a form is more frequent than its word, so there is no cycle."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stash(split_join(at, onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(counted: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for counted(word, n), each word once.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near
    word of the largest n, of equals the least in code-point order, if its n is at least ``times`` the
    word's; root follows the forms to the last (times must be over 1, so that they end). An empty
    table gives an empty result; other columns are ignored.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its variants")
    counted = stash(counted.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    near = near_pairs(counted, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = counted.join(near, "word", "left").withColumn("top", -F.col("best.order"))
    fit = F.col("top") >= F.col("n") * times
    rows = stash(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fit, F.col("best.near")).alias("form"), F.when(fit, F.col("top")).alias("form_n")), "forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame) -> DataFrame:
    """The spelling variants of documents(doc_id, text) by the stated lengths, counts and damage.

    Texts of any length are read whole; a null text has no words; repeated rows count again; ties are
    settled in spelling_variants; an empty table gives no rows; other columns are ignored.
    """
    return spelling_variants(words(docs))
