"""Spans and attempts as they happen: starts joined with ends under watermarks, and deadlines as timers of event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.streaming.events import BUCKETS, bucket_of, pack, unpack

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "item_id bigint, opened_at timestamp, provider_used string, retry_count int, failure_count int, route string"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the streams started inside, out of the heap; the session's own choice comes back after."""
    own = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, own)


def paired_spans(events: DataFrame, limit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(span_id, started_at, ended_at) of a stream of events(span_id, kind, at), kind start or end.

    An end counts for the start of its span at most limit before it; each one makes a row. A start
    without such an end has one row with a null end, as soon as the watermark (late behind the
    times seen on either side) has passed its limit. An end without a start, one that comes after
    the limit, and events without an id or a time make no row; nor does what is later than the
    watermark of the batch before, which Spark drops.
    State: a start until its limit, an end until the watermark reaches it.
    """
    starts = events.where("kind = 'start'").select("span_id", F.col("at").alias("started_at")).withWatermark("started_at", late)
    ends = events.where("kind = 'end'").select(F.col("span_id").alias("ended_span"), F.col("at").alias("ended_at")).withWatermark("ended_at", late)
    within = F.expr(f"span_id = ended_span AND ended_at >= started_at AND ended_at <= started_at + INTERVAL {limit}")
    return starts.where("span_id is not null").join(ends, within, "left_outer").select("span_id", "started_at", "ended_at")


def attempt_outcomes(attempts: DataFrame, limit: timedelta, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(item_id, opened_at, provider_used, retry_count, failure_count, route) of a stream of attempts(item_id, ord, at, provider, succeeded).

    An item is opened by its earliest attempt and decided when the watermark passes that time plus
    limit; attempts may come in any order until then. The first provider by ord counts, and, if it
    failed, the first attempt of another one. Without a success the item goes to ops_review if two
    providers failed, else to pending_triage. A decided item leaves the state; what comes later
    opens it again. Rows without an item, a time or a provider are left out; a null success is none,
    and a null ord comes last.
    State: the first attempts of the first two providers of each open item. Items are dealt to buckets;
    a bucket is one state value with one timer, for the earliest deadline in it.
    """
    limit_us = int(limit.total_seconds() * 1_000_000)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [unpack(state.get[0])] if state.exists else []
        rows = pd.concat(held + [b[["item_id", "at_us", "provider", "ord", "succeeded"]] for b in batches if len(b)])
        rows["at_us"] = rows.groupby("item_id")["at_us"].transform("min")
        first = rows.sort_values(["item_id", "ord", "provider", "succeeded"]).drop_duplicates(["item_id", "provider"])
        rank = first.groupby("item_id").cumcount()
        first, rank = first[rank < 2], rank[rank < 2]
        deadline = (first["at_us"] + limit_us) // 1000
        due = deadline < state.getCurrentWatermarkMs()
        if due.all():
            state.remove()
        else:
            state.update((pack(first[~due]),))
            state.setTimeoutTimestamp(max(1, int(deadline[~due].min())))
        if due.any():
            yield _outcomes(first[due & (rank == 0)], first[due & (rank == 1)])

    known = attempts.where("item_id is not null and at is not null and provider is not null").withWatermark("at", late)
    rows = known.select(bucket_of(F.col("item_id"), buckets).alias("bucket"), "item_id", F.coalesce("ord", F.lit(2**63 - 1)).alias("ord"), "at", F.unix_micros("at").alias("at_us"), "provider", F.coalesce("succeeded", F.lit(False)).alias("succeeded"))
    return rows.groupBy("bucket").applyInPandasWithState(decide, OUTCOME, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def _outcomes(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """What is decided of items by the first attempts of their first and second provider."""
    both = one.merge(two[["item_id", "provider", "succeeded"]], "left", "item_id", suffixes=("", "_2"))
    ok, again = both["succeeded"].astype(bool), both["provider_2"].notna()
    saved = ~ok & (both["succeeded_2"] == True)  # noqa: E712  null where there is no second
    used = both["provider"].where(ok, both["provider_2"].where(saved, None))
    failed = (~ok).astype("int32") + (~ok & again & ~saved).astype("int32")
    route = np.where(ok | saved, None, np.where(failed > 1, "ops_review", "pending_triage"))
    opened = pd.to_datetime(both["at_us"], unit="us", utc=True)
    return pd.DataFrame({"item_id": both["item_id"], "opened_at": opened, "provider_used": used, "retry_count": (~ok & again).astype("int32"), "failure_count": failed, "route": route})
