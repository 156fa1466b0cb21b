"""LM scoring with Brown's class-based bigram model.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). All statistics come from all training rows,
and every training word has a class:

1. Words are counted by their 64-bit hash. The head is the words that are looked up in a broadcast
   table: those seen at least t times, t being the smallest half power of two that keeps the head
   within ``head_words``. The others, the tail, are looked up by joins instead, to the same end.
2. The exchange algorithm moves each of the ``core_words`` most frequent words to the class that
   raises the likelihood of their bigrams most, until few move. This settles what the classes are.
3. In ``rounds`` distributed exchange steps every head word, those of the core too, moves to the class
   that makes its neighbours most likely. Tail words take theirs so after the last.
4. Class transitions are counted over all training rows. As often as a word is seen for the first
   and only time, an unknown word is to be expected: words seen once are counted a second time as
   the class of unknown words, which is one word to the model as it is to the base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import split_join, stash
from .textkit import text_chunks, word_bounds, word_hashes

HEAD_WORDS = 1 << 20  # 18 MB when broadcast
CORE_WORDS = 2048
CLASSES = 64
ROUNDS = 2
PASSES = 6
STRENGTH = 2.0
END = np.uint64(0xE4D)
_END_HASH = int(END)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every row, each followed by END, and each token's row."""
    starts, ends, row = word_bounds(buf, offsets)
    n_rows = len(offsets) - 1
    at = np.arange(len(row)) + row
    tokens = np.full(len(row) + n_rows, END, np.uint64)
    rows = np.zeros(len(tokens), np.int64)
    tokens[at] = word_hashes(buf, starts, ends)
    rows[at] = row
    rows[np.searchsorted(row, np.arange(1, n_rows + 1)) + np.arange(n_rows)] = np.arange(n_rows)
    return tokens, rows


def _lookup(sorted_keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Index of each token among the keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(tokens), -1, np.int64)
    at = np.searchsorted(sorted_keys, tokens)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == tokens, at, -1)


def _take(table: np.ndarray, at: np.ndarray, missing: int) -> np.ndarray:
    """table[at], or missing where at is -1."""
    return np.where(at >= 0, table[at] if len(table) else missing, missing)


class _Sums:
    """Sums by integer key, kept as sorted arrays and emptied when they have grown."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.held += len(found)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts])
        found, back = np.unique(keys, return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([n for _, n in self.parts]), minlength=len(found)).astype(np.int64)
        self.parts, self.held = [(found, sums)], len(found)
        return found, sums

    def full(self) -> bool:
        if self.held > 3 * self.most:
            self.merge()
        return self.held > self.most

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            found, sums = self.merge()
            for k in range(0, len(found), 1 << 16):
                yield found[k : k + (1 << 16)], sums[k : k + (1 << 16)]
        self.parts, self.held = [], 0


def _count(texts: DataFrame, key: str, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], wide: int | None = None) -> DataFrame:
    """(key, n): how often each 64-bit key occurs, summed within each task; not yet across tasks.

    With wide, the keys of one key // wide are one row (key, column array, n array).
    """

    def batch_of(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        if wide is None:
            return pa.record_batch({key: pa.array(found.view(np.int64)), "n": pa.array(n)})
        own = found // wide
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        offsets = pa.array(np.append(first, len(own)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (found % wide, n)]
        return pa.record_batch({key: pa.array(own[first]), "column": lists[0], "n": lists[1]})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for _, _, buf, offsets in text_chunks(batch.column(0)):
                sums.add(keys_of(*_tokens(buf, offsets)))
                if sums.held > 3 * sums.most and sums.full():
                    yield from (batch_of(*x) for x in sums.drain())
        yield from (batch_of(*x) for x in sums.drain())

    return texts.mapInArrow(counted, f"{key} bigint, n bigint" if wide is None else f"{key} bigint, column array<int>, n array<int>")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, size: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Classes of words 0..size-1, most frequent first, from their bigram counts n of (left, right).

    Words start in turn in the classes. Each pass takes every word out of its class and puts it
    where the bigram likelihood is highest; ties keep the lowest class. It ends when under one
    word in 200 moves, or after ``passes``.
    """
    classes = min(classes, max(size, 1))
    cls = np.arange(size) % classes
    out_order, in_order = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    out_at = np.searchsorted(left[out_order], np.arange(size + 1))
    in_at = np.searchsorted(right[in_order], np.arange(size + 1))
    table = np.zeros((classes, classes))
    np.add.at(table, (cls[left], cls[right]), n)
    row_sum, col_sum = table.sum(axis=1), table.sum(axis=0)
    for _ in range(passes):
        moved = 0
        for w in range(size):
            o, i = out_order[out_at[w] : out_at[w + 1]], in_order[in_at[w] : in_at[w + 1]]
            loop = right[o] == w
            own = n[o][loop].sum()
            to = np.bincount(cls[right[o][~loop]], weights=n[o][~loop], minlength=classes)
            not_loop = left[i] != w
            of = np.bincount(cls[left[i][not_loop]], weights=n[i][not_loop], minlength=classes)
            total_out, total_in = to.sum() + own, of.sum() + own
            if not total_out + total_in:
                continue
            a = cls[w]
            table[a] -= to
            table[:, a] -= of
            table[a, a] -= own
            row_sum[a] -= total_out
            col_sum[a] -= total_in
            rows_, cols_ = table + to, table + of[:, None]  # row b with w's followers; column b with its predecessors
            gain = (_xlogx(rows_) - _xlogx(table)).sum(axis=1) + (_xlogx(cols_) - _xlogx(table)).sum(axis=0)
            d = np.diagonal(table)
            gain += _xlogx(d + to + of + own) + _xlogx(d) - _xlogx(d + to) - _xlogx(d + of)
            gain -= _xlogx(row_sum + total_out) - _xlogx(row_sum) + _xlogx(col_sum + total_in) - _xlogx(col_sum)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[w] = b
            table[b] += to
            table[:, b] += of
            table[b, b] += own
            row_sum[b] += total_out
            col_sum[b] += total_in
        if moved * 200 < size:
            break
    return cls


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a DataFrame whose size is bounded, on the driver."""
    found = df.select(*names).toArrow()
    return [found.column(c).to_numpy() for c in names]


def _affinity(table: np.ndarray, classes: int) -> np.ndarray:
    """For a neighbour's place and class (before, then after): how much it speaks for each class of the word itself."""
    table = table + 0.1
    before = np.log(table[:, :classes] / table[:, :classes].sum(axis=0))
    after = np.log(table[:classes] / table[:classes].sum(axis=1, keepdims=True))
    return np.concatenate((before, after.T)).astype(np.float32)


def _likeliest(word: np.ndarray, column: np.ndarray, n: np.ndarray, affinity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, class) from neighbour counts sorted by word."""
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    sums = np.add.reduceat(affinity[column] * n[:, None].astype(np.float32), first, axis=0)
    return word[first], sums.argmax(axis=1)


def _assign(affinity: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(at, class) of the head words from (at, column array, n array) sorted by at."""

    def likeliest(held: list[np.ndarray]) -> pa.RecordBatch:
        at, got = _likeliest(*held, affinity)
        return pa.record_batch({"at": pa.array(at), "class": pa.array(got)})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # word, column, n
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            new = (np.repeat(batch.column(0).to_numpy(), sizes), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy())
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last word may go on in the next batch
            if whole:
                yield likeliest([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield likeliest(held)

    return assign


def _assign_tail(affinity: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(w, class) of the tail words from (w, seen array of (column, n))."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(1)
            each, index = seen.flatten(), np.repeat(np.arange(batch.num_rows), seen.value_lengths().to_numpy(zero_copy_only=False))
            if len(index):
                at, got = _likeliest(index, each.field(0).to_numpy(), each.field(1).to_numpy(), affinity)
                yield pa.record_batch({"w": batch.column(0).take(pa.array(at)), "class": pa.array(got)})

    return assign


def class_model_scores(docs: DataFrame, held_out: Column, classes: int = CLASSES, core_words: int = CORE_WORDS, head_words: int | None = HEAD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs(doc_id, text).

    The rows where held_out is false train. Text is lower-cased (A-Z); tokens are its words and
    one end. base_score is the add-one unigram log10 probability; score the class model's, and
    perplexity 10 ** (-score / n_tokens). Null and empty texts are one end token; a text of any
    length is scored whole; repeated rows count and score each; other columns are ignored. An empty
    table gives no rows; with no training rows all words are unknown.

    ``head_words`` bounds the memory of the broadcast table (None: no bound, all words are in it);
    words beyond it have classes and scores of the same kind, by joins, but do not tell the class
    of their neighbours. ``core_words`` bounds the words of the sequential exchange (None: all).
    """
    spark = docs.sparkSession
    END_CLASS, UNKNOWN, ALL, WIDE = classes, classes + 1, classes + 2, 2 * (classes + 2)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")

    words = _count(train, "w", lambda tokens, _: tokens).groupBy("w").agg(F.sum("n").alias("n"))
    words = stash(words.withColumn("level", F.floor(F.log2("n") * 2)), "words")  # n is at least 2 ** (level / 2)
    levels = words.groupBy("level").agg(F.sum("n").alias("sum"), F.count("*").alias("n")).collect()  # at most 127 rows
    n_all, n_words = sum(r["sum"] for r in levels), sum(r["n"] for r in levels)
    t = 0
    while head_words is not None and sum(r["n"] for r in levels if r["level"] >= t) > head_words + 1:
        t += 1
    head_w, head_n = _columns(words.where((F.col("level") >= t) & (F.col("w") != _END_HASH)), "w", "n")
    end_n = next((r["n"] for r in words.where(F.col("w") == _END_HASH).collect()), 0)
    head = head_w.view(np.uint64)
    order = np.argsort(head)
    head, head_n = head[order], head_n[order].astype(np.int64)

    # the exchange over the most frequent words
    by_count = np.lexsort((head, -head_n))[:core_words]
    core_at = np.sort(by_count)
    core, size = head[core_at], len(core_at)
    shared_core = spark.sparkContext.broadcast(core)

    def core_bigrams(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
        at = _lookup(shared_core.value, tokens)
        at[tokens == END] = size
        before = np.concatenate(([size], at[:-1]))
        both = (before >= 0) & (at >= 0)
        return before[both] * (size + 1) + at[both]

    pair, n = _columns(_count(train, "pair", core_bigrams).groupBy("pair").agg(F.sum("n").alias("n")), "pair", "n")
    left, right = pair // (size + 1), pair % (size + 1)
    inner = (left < size) & (right < size)
    rank = np.empty(size, np.int64)
    rank[np.lexsort((core, -head_n[core_at]))] = np.arange(size)
    head_class = np.full(len(head), -1, np.int16)
    if size:
        head_class[core_at] = exchange(rank[left[inner]], rank[right[inner]], n[inner].astype(float), size, classes)[rank]

    def class_table() -> np.ndarray:
        """Transitions between the core's classes."""
        own = np.append(head_class[core_at], END_CLASS)
        table = np.zeros((ALL, ALL))
        np.add.at(table, (own[left], own[right]), n)
        return table

    # exchange steps over all head words, by their neighbours of the head
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((head, head_class, k == 0))

        def contexts(tokens: np.ndarray, row: np.ndarray, shared=shared) -> np.ndarray:
            head, cls, first = shared.value
            at = _lookup(head, tokens)
            own = _take(cls, at, -1).astype(np.int64)
            own[tokens == END] = END_CLASS
            before, after = np.concatenate(([END_CLASS], own[:-1])), np.concatenate((own[1:], [END_CLASS]))
            moves = (at >= 0) & (own < 0) if first else at >= 0
            a, b = moves & (before >= 0), moves & (after >= 0)
            return np.concatenate((at[a] * WIDE + before[a], at[b] * WIDE + ALL + after[b]))

        # a word has at most WIDE counts from each task that saw it; they are summed as they stream by
        near = _count(train, "at", contexts, WIDE).repartition("at").sortWithinPartitions("at")
        at, got = _columns(near.mapInArrow(_assign(_affinity(class_table(), classes)), "at bigint, class bigint"), "at", "class")
        moved = int(head_n[at[head_class[at] != got]].sum())
        head_class = head_class.copy()
        head_class[at] = got
        shared.unpersist()
        if k and moved * 200 < head_n.sum():
            break
    lone = np.flatnonzero(head_class < 0)
    head_class[lone] = (head[lone] % np.uint64(classes)).astype(np.int16)

    # class transitions over all training rows; those of tail words by joins
    shared_class = spark.sparkContext.broadcast((head, head_class, head_n))

    def classes_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _lookup(shared_class.value[0], tokens)
        cls = _take(shared_class.value[1], at, -1).astype(np.int64)
        cls[tokens == END] = END_CLASS
        return at, cls

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def batch_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "n": pa.array(n)})

        for batch in batches:
            for _, _, buf, offsets in text_chunks(batch.column(0)):
                tokens, _ = _tokens(buf, offsets)
                at, cls = classes_of(tokens)
                once = _take(shared_class.value[2], at, 0) == 1
                was, seen_once, word = np.concatenate(([END_CLASS], cls[:-1])), np.concatenate(([False], once[:-1])), np.concatenate(([END], tokens[:-1]))
                known = (was >= 0) & (cls >= 0)
                sums.add(was[known] * ALL + cls[known])
                for own, a, b in ((known & once, was, None), (known & seen_once, None, cls), (known & once & seen_once, None, None)):
                    sums.add((UNKNOWN if a is None else a[own]) * ALL + (UNKNOWN if b is None else b[own]) + np.zeros(int(own.sum()), np.int64))
                to_known, to_tail, between = (was < 0) & (cls >= 0), (was >= 0) & (cls < 0), (was < 0) & (cls < 0)
                for kind, a, b in ((1, word[to_known], cls[to_known]), (2, tokens[to_tail], was[to_tail]), (3, word[between], tokens[between])):
                    if len(a):
                        yield batch_of(kind, a, b, np.ones(len(a), np.int64))
        for found, n in sums.drain():
            yield batch_of(0, found, np.zeros(len(found), np.int64), n)

    step = train.mapInArrow(steps, "kind int, a bigint, b bigint, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    if t:
        step = stash(step, "steps")
    table = np.zeros(ALL * ALL)
    at, n = _columns(step.where("kind = 0"), "a", "n")
    table[at] = n
    table = table.reshape(ALL, ALL)
    class_total = np.bincount(head_class, weights=head_n, minlength=ALL)
    tail = None
    if t:
        column = F.col("b") + F.when(F.col("kind") == 1, ALL).otherwise(0)
        seen = step.where("kind in (1, 2)").groupBy(F.col("a").alias("w")).agg(F.collect_list(F.struct(column.alias("column"), "n")).alias("seen"))  # 2 * ALL at most
        found = seen.mapInArrow(_assign_tail(_affinity(table, classes)), "w bigint, class bigint")
        tail = words.where((F.col("level") < t) & (F.col("w") != _END_HASH)).select("w", "n").join(found, "w", "left")
        tail = stash(tail.withColumn("class", F.coalesce("class", F.pmod("w", F.lit(classes)))), "tail-words")
        for row in tail.groupBy("class").agg(F.sum("n").alias("n")).collect():
            class_total[row["class"]] += row["n"]
        info = tail.select(F.col("w").alias("a"), F.col("class").alias("class_a"), (F.col("n") == 1).alias("once_a"))
        one = step.where("kind in (1, 2)").join(info, "a").groupBy("kind", "class_a", "once_a", "b").agg(F.sum("n").alias("n"))
        for row in one.collect():  # at most 4 * classes * ALL rows
            pairs = [(c, row["b"]) if row["kind"] == 1 else (row["b"], c) for c in (row["class_a"], *[UNKNOWN] * row["once_a"])]
            for cell in pairs:
                table[cell] += row["n"]
        right_info = info.select(F.col("a").alias("b"), F.col("class_a").alias("class_b"), F.col("once_a").alias("once_b"))
        two = step.where("kind = 3").join(info, "a").join(right_info, "b").groupBy("class_a", "once_a", "class_b", "once_b").agg(F.sum("n").alias("n"))
        for row in two.collect():  # at most 4 * classes ** 2 rows
            for a in (row["class_a"], *[UNKNOWN] * row["once_a"]):
                for b in (row["class_b"], *[UNKNOWN] * row["once_b"]):
                    table[a, b] += row["n"]
    base = (table.sum(axis=0) + 1) / (table.sum() + ALL)
    log_step = np.log10((table + STRENGTH * base) / (table.sum(axis=1, keepdims=True) + STRENGTH))
    log_total = np.log10(np.maximum(class_total, 1.0))
    log_emit = np.log10(head_n) - log_total[head_class]
    shared_score = spark.sparkContext.broadcast((log_step, log_emit, np.log10(head_n + 1.0), float(np.log10(end_n + 1.0))))

    missing = -1 if t else UNKNOWN

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_step, log_emit, log_count, log_end = shared_score.value
        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, end, buf, offsets in text_chunks(batch.column(1)):
                tokens, row = _tokens(buf, offsets)
                at, cls = classes_of(tokens)
                cls[cls < 0] = missing
                n_rows = end - first
                known, is_end = at >= 0, tokens == END
                was, follows = np.concatenate(([END_CLASS], cls[:-1])), np.concatenate((cls[1:], [END_CLASS]))
                sure = (was >= 0) & (cls >= 0)
                logs = np.where(sure, log_step[was, cls], 0.0)
                logs[known] += log_emit[at[known]]
                counts = np.where(is_end, log_end, 0.0)
                counts[known] = log_count[at[known]]
                rest = cls < 0
                cuts = pa.array(np.searchsorted(row[rest], np.arange(n_rows + 1)).astype(np.int32))
                lists = {"w": tokens[rest].view(np.int64), "before": was[rest], "after": follows[rest]}
                yield pa.record_batch(
                    {
                        "row_id": pa.array(np.arange(next_id, next_id + n_rows)),
                        "doc_id": batch.column(0).slice(first, n_rows),
                        "held_out": batch.column(2).slice(first, n_rows),
                        "n_tokens": pa.array(np.bincount(row, minlength=n_rows)),
                        "head_known": pa.array(np.bincount(row, weights=known | (is_end & (end_n > 0)), minlength=n_rows).astype(np.int64)),
                        "head_base": pa.array(np.bincount(row, weights=counts, minlength=n_rows)),
                        "head_score": pa.array(np.bincount(row, weights=logs, minlength=n_rows)),
                    }
                    | {k: pa.ListArray.from_arrays(cuts, pa.array(v)) for k, v in lists.items()}
                )
                next_id += n_rows

    schema = "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_base double, head_score double, w array<bigint>, before array<bigint>, after array<bigint>"
    parts = rows.select("doc_id", "text", "held_out").mapInArrow(score, schema)
    if tail is None:
        own = parts.select("doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score")
    else:
        parts = stash(parts, "head-scores")
        rest = stash(parts.select("row_id", F.posexplode(F.arrays_zip("w", "before", "after")).alias("pos", "x")).select("row_id", "pos", "x.*"), "tail-tokens")
        met = split_join(rest, tail.withColumnRenamed("n", "count"), "w", "left")
        each = met.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "before", "after", F.coalesce("class", F.lit(UNKNOWN)).alias("class"), F.coalesce("count", F.lit(0)).alias("count")))).alias("tail"))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log_step = shared_score.value[0]
            for batch in batches:
                held = batch.column(6)
                row = np.repeat(np.arange(batch.num_rows), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                _, was, follows, cls, n = [f.to_numpy(zero_copy_only=False) for f in held.flatten().flatten()]
                was = np.where(was < 0, np.concatenate(([END_CLASS], cls[:-1])), was)  # the tail word before it
                logs = log_step[was, cls] + np.where(follows >= 0, log_step[cls, follows], 0.0) + np.where(n > 0, np.log10(np.maximum(n, 1)) - log_total[cls], 0.0)
                add = lambda c, x: pa.array(batch.column(c).to_numpy() + np.bincount(row, weights=x, minlength=batch.num_rows).astype(batch.column(c).to_numpy().dtype))
                yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "n_tokens": batch.column(2), "head_known": add(3, n > 0), "head_base": add(4, np.log10(n + 1.0)), "head_score": add(5, logs)})

        together = parts.join(each, "row_id", "left").select("doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score", "tail")
        own = together.mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_base double, head_score double")
    return own.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("head_known").alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("head_base") - F.col("n_tokens") * float(np.log10(n_all + n_words + 1))).alias("base_score"),
        F.col("head_score").alias("score"),
        F.pow(F.lit(10.0), -F.col("head_score") / F.col("n_tokens")).alias("perplexity"),
    )
