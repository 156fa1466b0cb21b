"""Mixing sources to target weights: water-filled targets, repetition rates, and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, stash, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
RANKED_PER_TASK = 100_000
PLACED_PER_TASK = 10_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _ranked(sources: DataFrame, n: int) -> DataFrame:
    """sources with rank 0, 1, ... by code point, null last; ranges of the names are ranked apart and then shifted."""
    order = F.col("source").asc_nulls_last()
    parts = max(1, -(-n // RANKED_PER_TASK))
    ranged = stash(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranged")
    before, shift = 0, {}
    for row in ranged.groupBy("part").count().orderBy("part").collect():  # one row for each range
        shift[row["part"]] = before
        before += row["count"]
    start = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])[F.col("part")] if shift else F.lit(0)
    return ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + start).drop("part")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from sized(source, size).

    The sources, by code point and null last, take the weights in turn and share ``share`` times
    all sizes. A target stops at ``most`` times its source's size; the excess goes to the others
    by weight until none is above. Each round is one aggregate over the sources, and only its
    three sums reach the driver.
    """
    sums = stash(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    n = sums.count()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = stash(_ranked(sums, n).withColumn("weight", weight).withColumn("most", most * F.col("source_size")), "ranked")
    whole = ranked.agg(F.sum("source_size")).head()[0] or 0
    level, open_weight = 0.0, None
    while True:
        below = F.lit(True) if open_weight is None else F.col("most") > level * F.col("weight")
        full, weight_left = ranked.agg(F.sum(F.when(~below, F.col("most")).otherwise(0.0)), F.sum(F.when(below, F.col("weight")).otherwise(0.0))).head()
        if not weight_left or weight_left == open_weight:
            break
        level, open_weight = (share * whole - full) / weight_left, weight_left
    target = F.least(level * F.col("weight"), F.col("most"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return stash(ranked.select("source", "source_size", target.alias("target"), rate.alias("rate")), "targets")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def copies(doc_id: Column, digest: Column, place: Column, rate: Column, seed: str) -> Column:
    """floor(rate), plus one with probability rate - floor(rate) by a hash of the seed, the id, the text's digest and the place among equal rows."""
    written = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), digest, place.cast("string"))
    draw = F.conv(F.substring(F.md5(written.cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _placed(rows: DataFrame, key: str, keys: DataFrame, place: str) -> DataFrame:
    """rows with place: 1, 2, ... among the rows of one key. keys holds the key of every row.

    Only rows of keys that repeat are shuffled. Those of a key with more than PLACED_PER_TASK rows
    are dealt to parts, numbered part by part, and shifted by the rows of the parts before. The
    parts are drawn and written down once, so a task that runs again finds the same ones.
    """
    names = [*rows.columns, key, place]
    n, part, before = unused("mix_n", names), unused("mix_part", names), unused("mix_before", names)
    repeated = stash(keys.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > 1), "repeated")
    if repeated.isEmpty():
        return rows.withColumn(place, F.lit(1).cast("bigint"))
    marked = rows.join(broadcast_if_small(repeated), key, "left")
    single = marked.where(F.col(n).isNull()).withColumn(place, F.lit(1).cast("bigint")).drop(n)
    parts = F.ceil(F.col(n) / PLACED_PER_TASK)
    many = stash(marked.where(F.col(n).isNotNull()).withColumn(part, F.floor(F.rand(0) * parts)), "many")
    held = many.where(F.col(n) > PLACED_PER_TASK).groupBy(key, part).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select(key, part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    numbered = many.withColumn(place, F.row_number().over(Window.partitionBy(key, part).orderBy(key)))
    shifted = numbered.join(broadcast_if_small(shifts), [key, part], "left").withColumn(place, F.col(place) + F.coalesce(before, F.lit(0)))
    return single.unionByName(shifted.select(single.columns))


def _with_targets(rows: DataFrame, targets: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with these columns of their source's targets, under the names given."""
    key = unused("mix_key", rows.columns)
    right = targets.select(F.col("source").alias(key), *[F.col(k).alias(v) for k, v in names.items()])
    right = broadcast_if_small(right)
    return rows.join(right, rows["source"].eqNullSafe(right[key]), "left").drop(key)


def _sized(docs: DataFrame) -> DataFrame:
    """source, doc_id, size and digest of every row, and a key that rows equal in source, id and text share."""
    rows = docs.select("source", "doc_id", words_of(F.col("text")).alias("size"), _digest(F.col("text")).alias("digest"))
    return stash(rows.withColumn("key", _key(F.col("source"), F.col("doc_id"), F.col("digest"))), "sized")


def _key(source: Column, doc_id: Column, digest: Column) -> Column:
    """64 bits; where two groups of equal rows share them, they are numbered as one, which changes no row's chance."""
    return F.xxhash64(source.isNull(), source, doc_id.isNull(), doc_id, digest)


def mix_report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source).

    A null text has size 0 and takes nothing; null is a source of its own, the last. Texts of any
    length are counted whole. Rows that share an id, or have none, draw apart by their texts, and
    rows equal in source, id and text by their place among each other; any order of these gives
    the same rows. Other columns are ignored; an empty table gives no rows.
    """
    sized = _sized(docs)
    placed = _placed(sized, "key", sized.select("key"), "place")
    planned = _with_targets(placed, source_targets(sized), {k: k for k in ("source_size", "target", "rate")})
    taken = F.col("size") * copies(F.col("doc_id"), F.col("digest"), F.col("place"), F.col("rate"), seed)
    return planned.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of docs(doc_id, text, source) as often as it is taken, with all its columns and copy = 1, 2, ...

    Null and empty texts have size 0 and draw by their source's rate as others do; null is a
    source of its own, the last. Rows that share an id, or have none, draw apart by their texts;
    of rows equal in source, id and text a certain number gets a copy more, and which of them is
    open where their other columns differ. Other columns may have any names; if one is called copy,
    the number of the copy is called _copy. An empty table gives no rows.
    """
    sized = _sized(docs)
    key, place, rate, n = (unused(f"mix_{k}", docs.columns) for k in ("key_of_row", "place", "rate", "copies"))
    keyed = docs.withColumn(key, _key(F.col("source"), F.col("doc_id"), _digest(F.col("text"))))
    placed = _placed(keyed, key, sized.select(F.col("key").alias(key)), place)
    planned = _with_targets(placed, source_targets(sized), {"rate": rate})
    each = planned.withColumn(n, copies(F.col("doc_id"), _digest(F.col("text")), F.col(place), F.col(rate), seed)).where(F.col(n) > 0)
    return each.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(unused("copy", docs.columns)))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, digest) AS place FROM sized
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM sums
), filled AS (
  SELECT coalesce(sum(most) OVER w, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left FROM weighed
  WINDOW w AS (ORDER BY most / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max(((SELECT 1.5::DOUBLE * sum(source_size) FROM sums) - full_before) / weight_left) AS level FROM filled
), targets AS (
  SELECT source, source_size, least(level * weight, most) AS target,
         CASE WHEN source_size > 0 THEN least(level * weight, most) / source_size ELSE 0 END AS rate FROM weighed, level
), drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rate,
         CAST(CAST('0x' || left(md5(concat_ws(':', 'mix', coalesce(CAST(s.doc_id AS VARCHAR), ''), digest, place)), 8) AS BIGINT) AS DOUBLE) / 4294967296 AS draw
  FROM placed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""
