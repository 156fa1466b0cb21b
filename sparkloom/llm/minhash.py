"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text is cut into five-word shingles; 128 min-hashes summarise the set of shingles.
2. Texts with equal sets are one class, so exact copies cost one node. A doc_id with several
   different texts links their classes.
3. The signature's 32 bands of four give buckets. A pair at similarity 0.75 shares no bucket
   with a probability of about 5e-6.
4. Within a bucket not all pairs are tried: every member meets the bucket's hub. Only buckets
   whose members are then still in several components are looked at again, and pairs inside one
   component need no test, so a large group of near copies costs about one test a member. Of
   small such buckets all pairs across components are candidates. In large ones the largest
   component is set against the rest: both are dealt to blocks, and each pair of blocks is
   compared in a task of its own, which returns the pairs that pass and no others. A stray member
   thus costs one test against each of the others.
5. A candidate pair is compared in batches of 16 min-hashes. After each batch the pair is
   dropped if the posterior probability (uniform prior) that its similarity reaches the
   threshold is below ``miss``. Survivors are verified on their full sets of shingles.
6. Verified links are joined to components.

Keys that hold very many rows (buckets, hubs, classes, components) are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .graph import components
from .runtime import hot_keys, split_join, stash
from .textkit import mix64, shingle_sets, text_chunks

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
FILTER_BITS = 1 << 25
CHUNK_BYTES = 1 << 18  # texts cut into shingles at once, or one longer text

_rng = np.random.default_rng(1010)
_MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 min-hashes of 32 bits; blocks of shingles bound the memory."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(best, (shingles[k : k + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key + parts[:, :, k])
    return key.view(np.int64)


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets."""
    sums = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    others = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mix64(mix64(sums) + others + np.array([len(s) for s in sets], np.uint64)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, buf, offsets in text_chunks(batch.column(1), limit=CHUNK_BYTES):
            sets = shingle_sets(buf, offsets)
            sizes = np.array([len(s) for s in sets], np.int64)
            signatures = np.stack([signature(s) for s in sets])
            keys = band_keys(signatures)
            full = sizes > 0
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).slice(first, end - first),
                    "n_shingles": pa.array(sizes),
                    "node": pa.array(node_of(sets)),
                    "bands": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32)), pa.array(keys[full].ravel())),
                    "sig": pa.array([s.tobytes() if f else None for s, f in zip(signatures, full, strict=True)], pa.binary()),
                }
            )


def _fewest_matches(threshold: float, miss: float) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches that a pair needs to stay.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its mass at or above t is
    P(Binomial(n + 1, t) <= m).
    """
    fewest = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        fewest[n] = m
    return fewest


def _stays(threshold: float, miss: float):
    fewest = _fewest_matches(threshold, miss)

    @pandas_udf("boolean")
    def stays(left: pd.Series, right: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(left), np.uint32).reshape(-1, HASHES)
        b = np.frombuffer(b"".join(right), np.uint32).reshape(-1, HASHES)
        alive = np.arange(len(a))
        matches = np.zeros(len(a), np.int64)
        for n in range(BATCH, HASHES + 1, BATCH):
            matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
            alive = alive[matches[alive] >= fewest[n]]
        out = np.zeros(len(a), bool)
        out[alive] = True
        return pd.Series(out)

    return stays


def _similar(percent: int):
    @pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        def holds(x: bytes, y: bytes) -> bool:
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                return False
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        return pd.Series([holds(x, y) for x, y in zip(left, right, strict=True)], dtype=bool)

    return similar


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (4 MB) of the hashes of the doc_ids; it only ever lets too many through."""
    slot = ids.select((F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1).alias("h"))  # bitmap positions count from 1
    parts = slot.groupBy(F.bitmap_bucket_number("h").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():
        at = (row["part"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of these nodes, each once; nodes has (node, doc_id of a text of it)."""
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(nodes))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            slot = batch.column(1).to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array((held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for _, _, buf, offsets in text_chunks(part.column(0), limit=CHUNK_BYTES):
                found = shingle_sets(buf, offsets)
                yield pa.record_batch({"node": pa.array(node_of(found)), "shingles": pa.array([s.tobytes() for s in found], pa.binary())})

    slots = docs.where("doc_id is not null").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("h"))
    return slots.mapInArrow(sets, "node bigint, shingles binary").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


SMALL_BUCKET = 12
BLOCK_ROWS = 512
BLOCK_BYTES = 16 << 20


def _compare_blocks(percent: int, miss: float):
    """Over rows sorted by (key, p, q): the pairs across components, and across the two blocks if p <> q, that are similar."""
    fewest = _fewest_matches(percent / 100, miss)

    def pairs_of(rows: list[tuple[int, int, int, bytes, bytes]], across: bool) -> Iterator[tuple[int, int]]:
        nodes, comps, blocks = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets], np.int64)
        signatures = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(-1, HASHES)
        for k in range(len(nodes)):
            rest = np.arange(k + 1, len(nodes))
            fits = (comps[rest] != comps[k]) & (100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k]))
            rest = rest[fits & (blocks[rest] != blocks[k])] if across else rest[fits]
            matches = np.zeros(len(rest), np.int64)
            for n in range(BATCH, HASHES + 1, BATCH):
                matches += (signatures[rest, n - BATCH : n] == signatures[k, n - BATCH : n]).sum(axis=1)
                stay = matches >= fewest[n]
                rest, matches = rest[stay], matches[stay]
            for j in rest:
                both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[k] + sizes[j] - both):
                    yield min(nodes[k], nodes[j]), max(nodes[k], nodes[j])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def flush() -> pa.RecordBatch:
            found = list(pairs_of(held, own[1] != own[2]))
            return pa.record_batch({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        for batch in batches:
            for key, p, q, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != (key, p, q):
                    if held:
                        yield flush()
                    held, own = [], (key, p, q)
                held.append(row)
        if held:
            yield flush()

    return compare


def _seats(many: DataFrame) -> DataFrame:
    """(key, p, q, node, comp, block) for the blocks of large buckets (key, node, comp, n_shingles) that must meet.

    The members of the largest component of a bucket are blocks 0, 1, ... and all others blocks
    -1, -2, ...; blocks of the first kind meet only those of the second, which also meet each other.
    """
    sizes = many.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", "shingles")).alias("most"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    blocks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(shingles * 8 / BLOCK_BYTES), F.lit(1))
    largest = F.col("most")
    plan = sizes.select("key", largest["comp"].alias("largest"), blocks(largest["n"], largest["shingles"]).alias("ours"), blocks(F.col("n") - largest["n"], F.col("shingles") - largest["shingles"]).alias("others"))
    placed = split_join(many, stash(plan, "plan"), "key")
    inside, hashed = F.col("comp") == F.col("largest"), F.xxhash64("node")
    block = F.when(inside, F.pmod(hashed, F.col("ours"))).otherwise(-1 - F.pmod(hashed, F.col("others")))
    facing = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("others")), lambda k: -k)
    facing = F.when(inside, facing).otherwise(F.concat(facing, F.sequence(F.lit(0).cast("bigint"), F.col("ours") - 1)))
    dealt = placed.select("key", "node", "comp", block.alias("block"), F.explode(facing).alias("other"))
    return dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "comp", "block")


def _verify(pairs: DataFrame, signatures: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) of nodes that reach the similarity; a may be in very many of them."""

    def sides(table: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
        return tuple(table.select(F.col("node").alias(x), F.col(value).alias(f"{value}_{x}")) for x in "ab")

    sig_a, sig_b = sides(signatures, "sig")
    likely = split_join(pairs, sig_a, "a").join(sig_b, "b").where(_stays(percent / 100, miss)("sig_a", "sig_b")).select("a", "b")
    likely = stash(likely, "likely")
    if likely.isEmpty():
        return likely
    nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = stash(_sets_of(docs, stash(nodes.join(reps, "node"), "nodes")), "sets")
    set_a, set_b = sides(sets, "shingles")
    sure = split_join(likely, set_a, "a").join(set_b, "b").where(_similar(percent)("shingles_a", "shingles_b")).select("a", "b")
    return stash(sure, "links")


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Other columns are ignored, whatever their names. A null or empty text has no shingles and
    links with nothing; a text of one to four words has one shingle, the whole sequence; texts of
    any length are read whole. Rows that repeat a doc_id are one document: it links with all that
    any of its texts links with, and its rows get one component, but for rows without shingles,
    which have their own id; n_shingles is each row's own. A null doc_id links with nothing and is
    kept. Among equals the smallest doc_id is kept. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    rows = stash(docs.mapInArrow(_sketches, "doc_id bigint, n_shingles bigint, node bigint, bands array<bigint>, sig binary"), "sketches")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    reps = stash(known.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "reps")
    heads = known.select("doc_id", "node", "n_shingles", "bands").join(reps, ["node", "doc_id"], "left_semi").dropDuplicates(["node", "doc_id"])
    banded = stash(heads.select("node", "n_shingles", F.explode("bands").alias("key")), "banded")
    shared = stash(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "shared")
    members = stash(split_join(banded, shared, "key", hot=hot_keys(banded, "key", shared)), "members")
    wanted = stash(members.select("node").distinct().join(reps, "node"), "wanted")
    signatures = known.select("node", "doc_id", "sig").join(wanted, ["node", "doc_id"], "left_semi").dropDuplicates(["node", "doc_id"])
    signatures = stash(signatures.select("node", "sig"), "signatures")

    pairs = stash(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stash(_verify(pairs, signatures, reps, docs, percent, miss).union(_same_id(known)), "links")
    labels = components(links)
    placed = members.where("n > 2").select("key", "node", "n", "n_shingles").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stash(placed, "placed")
    split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high")
    split = stash(split.select("key", "n"), "split")
    if not split.isEmpty():
        open_ = stash(split_join(placed, split.select("key"), "key", hot=hot_keys(placed, "key", split)), "open")
        few, many = open_.where(F.col("n") <= SMALL_BUCKET), open_.where(F.col("n") > SMALL_BUCKET)
        met = few.select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a")).join(few.select("key", F.col("node").alias("b"), F.col("comp").alias("comp_b")), "key")
        met = stash(met.where("a < b and comp_a <> comp_b").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        links = links.union(_verify(met, signatures, reps, docs, percent, miss))
        if not many.isEmpty():
            sets = _sets_of(docs, stash(many.select("node").distinct().join(reps, "node"), "nodes"))
            seats = _seats(many).join(stash(sets.join(signatures, "node"), "sets"), "node")
            seats = seats.select("key", "p", "q", "node", "comp", "block", "shingles", "sig").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
            links = links.union(seats.mapInArrow(_compare_blocks(percent, miss), "a bigint, b bigint"))
        labels = components(stash(links.distinct(), "links"))

    smallest = labels.join(reps, "node").groupBy("comp").agg(F.min("doc_id").alias("least"))
    least = split_join(labels, smallest, "comp").select("node", "least")
    least = stash(reps.join(least, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component_id")), "least")
    linked = split_join(known.select("doc_id", "n_shingles", "node"), least, "node").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(known: DataFrame) -> DataFrame:
    """(a, b): the nodes of doc_ids that have several texts."""
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    several = stash(several.select("doc_id", "a"), "several")
    if several.isEmpty():
        return several.select("a", F.col("a").alias("b"))
    return split_join(known.select("doc_id", "node"), several, "doc_id").select("a", F.col("node").alias("b")).where("a < b").distinct()
