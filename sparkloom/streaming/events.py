"""Structured streaming over the events table: windowed counts and a lifecycle kept as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from sparkloom.operators.workflow import INGEST_MOVES

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
BUCKETS = 1024


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, some at a time, with the time as an instant."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum by window and type; what comes later than the watermark is dropped."""
    grouped = events.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def bucket_of(item: Column, buckets: int) -> Column:
    """The bucket of an item; those without an item have one of their own."""
    return F.when(item.isNull(), -1).otherwise(F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int"))


def pack(rows: pd.DataFrame) -> bytes:
    """A bucket's rows as one state value."""
    held = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as writer:
        writer.write_table(held)
    return sink.getvalue().to_pybytes()


def unpack(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_all().to_pandas()


def lifecycle_stream(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """events(item_id, ord, to_state): after each batch the lawful state of every item it touched.

    Items are dealt to buckets; a bucket's items are one state value and are folded in one call, as a call
    for each item costs more than its few moves. A batch reads and writes the buckets that it touches whole.
    """
    allowed = {(a, b) for a, bs in INGEST_MOVES.items() for b in bs}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("ord", kind="stable")
        held = unpack(state.get[0]) if state.exists else pd.DataFrame({"item_id": pd.Series(dtype="int64"), "state": pd.Series(dtype=object), "moves": pd.Series(dtype="int32"), "illegal": pd.Series(dtype="int32")})
        touched = held["item_id"].isin(rows["item_id"])
        now = {item: list(rest) for item, *rest in held[touched].itertuples(index=False)}
        for item, to in zip(rows["item_id"].tolist(), rows["to_state"].tolist(), strict=True):
            s = now.setdefault(item, ["", 0, 0])
            if (s[0], to) in allowed:
                s[0], s[1] = to, s[1] + 1
            elif s[0] != to:
                s[2] += 1
        states, moves, illegal = zip(*now.values(), strict=True)
        out = pd.DataFrame({"item_id": np.array(list(now), "int64"), "state": states, "moves": np.array(moves, "int32"), "illegal": np.array(illegal, "int32")})
        state.update((pack(pd.concat([held[~touched], out]) if len(held) else out),))
        yield out if key[0] >= 0 else out.assign(item_id=pd.array([None], "Int64"))

    out = "item_id bigint, state string, moves int, illegal int"
    rows = events.select(bucket_of(F.col("item_id"), buckets).alias("bucket"), F.coalesce("item_id", F.lit(0)).cast("bigint").alias("item_id"), "ord", "to_state")
    return rows.groupBy("bucket").applyInPandasWithState(fold, out, "held binary", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream writes when it has read all there is; batches are Parquet in a folder of their own."""
    spark, name = stream.sparkSession, uuid.uuid4().hex
    out = f"{folder}/stream-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/number={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    schema = stream.schema.add("batch", IntegerType())
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows").drop("number")
