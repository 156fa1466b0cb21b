"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Word inputs come from how surely a word, and character inputs how surely its character 4- and
5-grams, go with the label, measured on the training sample with cross-fitting: a training
text's inputs are measured on the other half of the sample, so chance words teach nothing.
The network reads windows of 48 words that overlap by 16; a text's score is that of its most
toxic window. As only texts are labelled, a toxic text trains with its most suspect window, and
a clean one with that, one by chance and, the second time, the one the network erred on most.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import text_chunks, word_bounds, word_hashes

BUCKETS = 1 << 18
STEPS, STRIDE = 48, 32
HIDDEN, ATTEND = 8, 8
INPUTS = 6
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000  # the bound of the training sample, in texts
SAMPLE_BYTES = 32 << 20  # and in bytes
EPOCHS, BATCH, LEAST_STEPS = 4, 192, 150
THRESHOLD = 0.3
MARGIN = 1.5  # logits by which the threshold stays below the least toxic text that it is to catch, at most
LEAST_KEPT = 400  # of a smaller sample all texts train, and set the threshold too
BLOCK = 2048

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False
_PAD = 4
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F), np.uint32(0x165667B1))

Tables = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Vocabulary:
    """The distinct words of some rows: their buckets and those of their character n-grams."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, row = word_bounds(buf, offsets, _APART)
        self.row = row.astype(np.int32)
        hashes = word_hashes(buf, starts, ends)
        distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = word.astype(np.int32)
        self.bucket = ((distinct >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)
        starts, length = starts[first], (ends - starts)[first]
        # every word as ^word$ and four blanks, one after another
        own = length + 2 + _PAD
        base = np.concatenate(([0], np.cumsum(own)))
        chars = np.zeros(int(base[-1]), np.uint8)
        chars[base[:-1]] = ord("^")
        inner = np.arange(int(length.sum())) - np.repeat(np.concatenate(([0], np.cumsum(length)))[:-1], length)
        chars[np.repeat(base[:-1] + 1, length) + inner] = buf[np.repeat(starts, length) + inner]
        chars[base[:-1] + 1 + length] = ord("$")
        self.length = length
        self.gram_start = np.concatenate(([0], np.cumsum(length + 2)))[:-1]
        place = np.repeat(base[:-1] - self.gram_start, length + 2) + np.arange(int((length + 2).sum()))
        code = np.zeros(len(place), np.uint32)
        self.grams = []
        for k in range(5):
            code = (code ^ chars[place + k]) * _MIX[k]
            if k >= 3:
                self.grams.append(((code ^ (code >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int32))

    def inputs(self, tables: Tables) -> np.ndarray:
        """One row of inputs for each distinct word."""
        if not len(self.length):
            return np.zeros((0, INPUTS), np.float32)
        four, five = tables[1][self.grams[0]], tables[2][self.grams[1]]
        n = (self.length + 2).astype(np.float32)
        return np.stack(
            (
                tables[0][self.bucket],
                np.maximum.reduceat(four, self.gram_start),
                np.maximum.reduceat(five, self.gram_start),
                np.add.reduceat(five, self.gram_start) / n,
                np.minimum.reduceat(five, self.gram_start),
                np.log(n) / 3,
            ),
            axis=1,
        ).astype(np.float32)


def _windows(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end of the row's words, and row of every window; none for a row without words."""
    cuts = np.searchsorted(row, np.arange(n_rows + 1))
    sizes = np.diff(cuts)
    count = np.where(sizes > 0, np.maximum(0, -(-(sizes - STEPS) // STRIDE)) + 1, 0)
    of = np.repeat(np.arange(n_rows), count)
    nth = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
    return cuts[of] + nth * STRIDE, cuts[of + 1], of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers, one in each direction, attention over their states, and a logit."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(INPUTS, 3 * HIDDEN)), ("U", draw(HIDDEN, 3 * HIDDEN)), ("c", np.zeros(3 * HIDDEN, np.float32)))}
        self.p |= {"A": draw(2 * HIDDEN, ATTEND), "a": draw(ATTEND), "o": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        self.shift = 0.0

    def _layer(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (step, window, unit) from input gates (step, window, 3 units)."""
        u = self.p[f"U{d}"]
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            g, r_ = gates[t], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + r_[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * r_[:, 2 * HIDDEN :])
            step = mask[t][:, None] * (1 - z)
            if keep is not None:
                keep.append((t, h, z, r, n, r_[:, 2 * HIDDEN :]))
            h = h + step * (n - h)
            out[t] = h
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        inner = np.tanh(states @ self.p["A"])
        weight = inner @ self.p["a"] + np.where(mask > 0, 0, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return inner, weight, pooled, pooled @ self.p["o"] + self.p["b"][0]

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input gates of both directions, side by side, for rows of inputs."""
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"], axis=-1)

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = [self._layer(d, gates[:, :, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN], mask, None) for k, d in enumerate("fb")]
        return self._pool(np.concatenate(both, axis=2), mask)[3] + self.shift

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by back-propagation through time; x is (step, window, input)."""
        p, keeps, states = self.p, {}, []
        for d in "fb":
            keeps[d] = []
            states.append(self._layer(d, x @ p[f"W{d}"] + p[f"c{d}"], mask, keeps[d]))
        s = np.concatenate(states, axis=2)
        inner, weight, pooled, logit = self._pool(s, mask)
        d_logit = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        grad = {"o": pooled.T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["o"]
        d_s = weight[:, :, None] * d_pool
        d_weight = np.einsum("tbh,bh->tb", s, d_pool)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["a"] = np.einsum("tb,tbk->k", d_weight, inner)
        d_inner = d_weight[:, :, None] * p["a"] * (1 - inner**2)
        grad["A"] = np.einsum("tbh,tbk->hk", s, d_inner)
        d_s += d_inner @ p["A"].T
        for k, d in enumerate("fb"):
            u, own = p[f"U{d}"], d_s[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            g_w, g_u, g_c = np.zeros_like(p[f"W{d}"]), np.zeros_like(u), np.zeros_like(p[f"c{d}"])
            d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, n, rec in reversed(keeps[d]):
                d_h = d_h + own[t]
                m = mask[t][:, None]
                d_n = d_h * m * (1 - z) * (1 - n**2)
                d_z = d_h * m * (h - n) * z * (1 - z)
                d_r = d_n * rec * r * (1 - r)
                d_gate = np.concatenate((d_z, d_r, d_n), axis=1)
                d_rec = np.concatenate((d_z, d_r, d_n * r), axis=1)
                g_w += x[t].T @ d_gate
                g_c += d_gate.sum(axis=0)
                g_u += h.T @ d_rec
                d_h = d_h * (1 - m * (1 - z)) + d_rec @ u.T
            grad |= {f"W{d}": g_w, f"U{d}": g_u, f"c{d}": g_c}
        return grad

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam over shuffled batches; x is (window, step, input)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        done = 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))):
            order = rng.permutation(len(y))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                grad = self.gradients(x[own].transpose(1, 0, 2), mask[own].T, y[own])
                done += 1
                for name, g in grad.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] = (self.p[name] - 0.02 * first[name] / (1 - 0.9**done) / (np.sqrt(second[name] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)


def _association(vocabularies: list[_Vocabulary], y: np.ndarray) -> Tables:
    """By bucket, for words, 4-grams and 5-grams: how surely texts that hold it are toxic, a clipped z score."""
    tables = []
    n_toxic, n_clean = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    for kind in range(3):
        seen = np.zeros((2, BUCKETS))
        for v, label in zip(vocabularies, y, strict=True):
            seen[int(label), np.unique(v.bucket if kind == 0 else v.grams[kind - 1])] += 1
        clean, toxic = seen + 0.5
        ratio = np.log(toxic / (n_toxic + 1)) - np.log(clean / (n_clean + 1))
        z = ratio / np.sqrt(1 / toxic + 1 / clean)
        tables.append((np.where(seen.sum(axis=0) > 0, np.clip(z, -4, 12), 0) / 4).astype(np.float32))
    return tables[0], tables[1], tables[2]


def fit(texts: list[str], labels: list[int], clean_weight: float = 1.0) -> tuple[Tables, Network]:
    """Association tables and network from a sample of labelled texts that the driver can hold.

    clean_weight is how many labelled clean texts one of the sample stands for, over the same for
    toxic ones; it counts where the threshold is set.
    """
    y = np.array(labels, np.int64)
    vocabularies = []
    for text in texts:
        for _, _, buf, offsets in text_chunks(pa.array([text], pa.string())):
            vocabularies.append(_Vocabulary(buf, offsets))
    network = Network()
    if len(set(labels)) < 2:
        network.p = {k: np.zeros_like(v) for k, v in network.p.items()}
        network.shift = 6.0 if labels and labels[0] else -6.0
        return _association(vocabularies, y), network
    half = np.arange(len(y)) % 2
    halves = [_association([v for v, h in zip(vocabularies, half, strict=True) if h != k], y[half != k]) for k in (0, 1)]
    usable = [k for k, v in enumerate(vocabularies) if len(v.word)]
    kept_back = {k for k in usable if k % 8 in (3, 6)} if len(usable) >= LEAST_KEPT else set()  # a quarter, from both halves, to set the threshold on

    given = {k: vocabularies[k].inputs(halves[half[k]]) for k in usable}

    rng = np.random.default_rng(7)
    chosen = {}
    for k in usable:
        x = given[k][vocabularies[k].word]
        start, end, _ = _windows(np.zeros(len(x), np.int32), 1)
        suspect = x[:, :3].sum(axis=1)
        peak = np.array([suspect[a : min(a + STEPS, b)].max() for a, b in zip(start, end, strict=True)])
        chosen[k] = {int(np.argmax(peak))} | (set() if y[k] else {int(rng.integers(len(start)))})
    # twice: with the windows that look suspect, and then also with those that the network takes for toxic
    for _ in range(2):
        xs, masks, ys = [], [], []
        for k in usable:
            if k in kept_back:
                continue
            x = given[k][vocabularies[k].word]
            for w in sorted(chosen[k]):
                got = x[w * STRIDE : w * STRIDE + STEPS]
                xs.append(np.pad(got, ((0, STEPS - len(got)), (0, 0))))
                masks.append(np.arange(STEPS) < len(got))
                ys.append(y[k])
        network.train(np.stack(xs), np.stack(masks).astype(np.float32), np.array(ys, np.float32))
        top = np.full(len(y), -30.0)
        for k, logit in zip(usable, _each_logits([(vocabularies[k].word, given[k]) for k in usable], network), strict=True):
            top[k] = logit.max()
            chosen[k] = {int(np.argmax(logit))} if y[k] else chosen[k] | {int(np.argmax(logit))}
    # move the logits so that the threshold parts the texts kept back best, by F1
    judged = np.array(sorted(kept_back) or usable, np.int64)
    order = judged[np.argsort(-top[judged])]
    hits = np.cumsum(y[order])
    false = clean_weight * np.cumsum(1 - y[order])
    f1 = 2 * hits / (hits + false + max(1, int(y[judged].sum())))
    best = int(np.argmax(f1))
    below = top[order[best + 1]] if best + 1 < len(order) else top[order[best]] - 2
    cut = top[order[best]] - min((top[order[best]] - below) / 2, MARGIN)
    network.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.clip(cut, -25, 25))
    return _association(vocabularies, y), network


def _window_logits(word: np.ndarray, row: np.ndarray, n_rows: int, inputs: np.ndarray, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """Logit and row of every window of some rows, in blocks; inputs has a row for each distinct word."""
    gates = network.gates(inputs).astype(np.float32) if len(word) else np.zeros((1, 6 * HIDDEN), np.float32)
    start, stop, of = _windows(row, n_rows)
    out = np.zeros(len(start))
    for k in range(0, len(start), BLOCK):
        at = start[k : k + BLOCK] + np.arange(STEPS)[:, None]
        inside = at < stop[k : k + BLOCK]
        at[~inside] = 0
        out[k : k + BLOCK] = network.logits(gates[word[at]], inside.astype(np.float32))
    return out, of


def _each_logits(texts: list[tuple[np.ndarray, np.ndarray]], network: Network) -> Iterator[np.ndarray]:
    """The window logits of each of some texts (words, inputs), several texts at a time."""
    first = 0
    while first < len(texts):
        end, held = first, 0
        while end < len(texts) and (end == first or held + len(texts[end][0]) <= BLOCK * STRIDE):
            held += len(texts[end][0])
            end += 1
        part = texts[first:end]
        shift = np.concatenate(([0], np.cumsum([len(x) for _, x in part])))[:-1]
        word = np.concatenate([w + s for (w, _), s in zip(part, shift, strict=True)])
        row = np.repeat(np.arange(len(part)), [len(w) for w, _ in part])
        logit, of = _window_logits(word, row, len(part), np.concatenate([x for _, x in part]), network)
        yield from np.split(logit, np.searchsorted(of, np.arange(1, len(part))))
        first = end


def _score_rows(column: pa.Array, tables: Tables, network: Network) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) over runs of rows."""
    for first, end, buf, offsets in text_chunks(column):
        v = _Vocabulary(buf, offsets)
        logit, of = _window_logits(v.word, v.row, end - first, v.inputs(tables), network)
        top = np.zeros(end - first)
        np.maximum.at(top, of, _sigmoid(logit))
        yield first, top


def _sampled(docs: DataFrame, labels: DataFrame, trains: Column, toxic: int, clean: int, byte_limit: int) -> tuple[list[str], list[int], float]:
    """A bounded sample of labelled texts, of each label the first by a hash of the id; and fit()'s clean_weight.

    Texts of over a fiftieth of byte_limit do not train; of the others, those that keep each label
    within half of it. An id with several texts trains with the one of the smallest hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(trains).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic).union(known.where("toxic = 0").orderBy(*order).limit(clean))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= byte_limit // 50).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(*order))  # over a bounded number of rows
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= byte_limit // 2).toArrow().sort_by("doc_id")
    whole = dict(known.groupBy("toxic").count().collect())
    weight = max(1, whole.get(0, 0) / clean) / max(1, whole.get(1, 0) / toxic)
    return rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), weight


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, byte_limit: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    held_out is an expression of doc_id; labels(doc_id, toxic) of ids where it is false train, at
    most ``toxic`` and ``clean`` texts of ``byte_limit`` bytes in all, whole ones. The score uses the
    text alone, whole. A text without words, null and empty ones among them, scores 0. Labels that
    are null, of other values or of unknown ids are ignored; an id labelled both ways is toxic;
    without labels of both kinds all texts score alike. Repeated rows score alike, and texts that
    share an id each by its own; other columns are ignored; an empty table gives no rows.
    """
    shared: Any = docs.sparkSession.sparkContext.broadcast(fit(*_sampled(docs, labels, ~held_out, toxic, clean, byte_limit)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, network = shared.value
        for batch in batches:
            for first, top in _score_rows(batch.column(1), tables, network):
                own = [batch.column(k).slice(first, len(top)) for k in (0, 2)]
                yield pa.record_batch({"doc_id": own[0], "held_out": own[1], "score": pa.array(top)})

    scored = docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(score, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
