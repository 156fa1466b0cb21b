"""Helpers shared by the corpus operators: reading tables, cutting lineage in the shared folder, and splitting hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than one in so many rows is hot. There are at most so many of them, so they may be collected and broadcast.
HOT = 10_000
LEAST_HOT = 1_000

#: Most bytes of an Arrow batch in what stash writes; a batch lies in memory several times, on both sides of the pipe to Python.
BATCH_BYTES = "2m"
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of this machine only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound Arrow batches by BATCH_BYTES for the jobs started inside; the session's own setting comes back after them."""
    own = spark.conf.get(_BATCH_BYTES_KEY, None)
    spark.conf.set(_BATCH_BYTES_KEY, BATCH_BYTES)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_BATCH_BYTES_KEY)
        else:
            spark.conf.set(_BATCH_BYTES_KEY, own)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    Its Arrow batches are small. The tables stay until that folder is cleared, as what is returned
    may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str, counts: DataFrame | None = None) -> list[tuple[int, int]]:
    """(key, parts) of the keys with more than LEAST_HOT rows of df and more than a HOT-th of all: HOT keys at most.

    counts(key, n), where it is known already, holds the rows of every key of df that may be hot.
    """
    share = max(LEAST_HOT, df.count() // HOT)
    if counts is None:
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return [(row[key], -(-row["n"] // share)) for row in counts.where(F.col("n") > share).select(key, "n").collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list[tuple[int, int]] | None = None) -> DataFrame:
    """left joined with right on key, where left may hold a key very often and right holds each key once.

    The rows of a hot key are dealt to parts by their hash, and right's row of it is copied for each
    part (HOT copies at most, twice over), so no task gets all rows of one key. left should be
    cheap to read, as it is counted first unless hot is given; its columns should be hashable.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    parts = F.broadcast(left.sparkSession.createDataFrame(hot, f"{key} {left.schema[key].dataType.simpleString()}, _parts bigint"))
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0))
    dealt = left.join(parts, key, "left").withColumn("_part", salt).drop("_parts")
    copied = right.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def broadcast_if_small(df: DataFrame, rows: int = 200_000, byte_limit: int = 32 << 20) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows and bytes of text; else as it is, to be joined by a shuffle."""
    texts = [F.sum(F.coalesce(F.octet_length(f.name), F.lit(0))) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    n, *sizes = df.agg(F.count("*"), *texts).head()
    return F.broadcast(df) if n <= rows and sum(x or 0 for x in sizes) <= byte_limit else df


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
