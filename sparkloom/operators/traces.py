"""Trace contexts: carriers of strings, and the trees that spans and runs make of their parents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.tooling import json_text

NO_TAGS = "map<string,string>"
PARTS = ("run-id", "parent-run-id", "parent-span-id")


def inject(prefix: str, tags: Column, trace_id: Column, *parts: Column, carrier: Column | None = None) -> Column:
    """The carrier of a context: prefix + id, run-id, parent-run-id, parent-span-id where they are not empty, and tags as JSON.

    Tags are written with sorted keys, in ASCII, and left out where there are none. What carrier held before
    stays, but for these keys. A null trace is written as an empty one.
    """
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda x: F.concat(json_text(x["key"]), F.lit(": "), json_text(x["value"])))
    written = F.when(F.size(tags) > 0, F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))
    entry = lambda name, value: F.struct(F.lit(prefix + name).alias("key"), value.alias("value"))
    entries = [entry("id", F.coalesce(trace_id, F.lit("")))]
    entries += [F.when(value != "", entry(name, value)) for name, value in (*zip(PARTS, parts, strict=True), ("tags", written))]
    own = F.map_from_entries(F.array_compact(F.array(*entries)))
    return own if carrier is None else F.map_concat(F.map_filter(carrier, lambda k, _: ~F.map_contains_key(own, k)), own)


def extract(prefix: str, carrier: Column) -> Column:
    """The context of a carrier as a struct, null without a trace that is not blank. Tags that are no JSON object are no tags.

    Values of tags become texts: true and false are True and False, null is None, nested values stay JSON.
    """
    at = lambda name: F.try_element_at(carrier, F.lit(prefix + name))
    kind = lambda v: F.schema_of_variant(v)
    raw = F.try_variant_get(F.try_parse_json(at("tags")), "$", "map<string,variant>")
    plain = lambda v: F.when(kind(v) == "BOOLEAN", F.initcap(v.cast("string"))).when(kind(v) == "VOID", "None").when(F.rlike(kind(v), F.lit("^(OBJECT|ARRAY)")), F.to_json(v)).otherwise(v.cast("string"))
    tags = F.coalesce(F.transform_values(raw, lambda _, v: plain(v)), F.create_map().cast(NO_TAGS))
    context = F.struct(at("id").alias("trace_id"), *[at(name).alias(name.replace("-", "_")) for name in PARTS], tags.alias("tags"))
    return F.when(~F.rlike(at("id"), F.lit(r"^\s*$")), context)


def trees(spans: DataFrame, folder: str) -> DataFrame:
    """(span_id, root, depth, tags, issue) of spans(span_id, parent_id, tags): what a span inherits from all above it.

    A tag of a span hides that of one above. A parent that is not among the spans is an issue, orphan, and its child
    a root of its own. Spans on a cycle, or below one, have the issue cycle, no root and no depth, and their own tags.
    span_id is unique and not null; a null parent makes a root. A null map has no tags.

    The way to the root is doubled round by round, so n levels take log2(n) rounds; only spans whose way is open are
    joined again, and Spark splits the partitions of a parent with very many of them. What is left when a round
    closes no way hangs on a cycle. Each round writes the spans that it moved to folder, which all
    executors share; those whose way is closed stay in the files of the round that closed it.
    """
    spark, place = spans.sparkSession, f"{folder}/trees-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.schema(df.schema).parquet(f"{place}/{name}")

    own = F.coalesce(F.col("tags"), F.create_map().cast(NO_TAGS))
    known = spans.select(F.col("span_id").alias("parent_id"), F.lit(True).alias("known"))
    lost = F.col("parent_id").isNotNull() & F.col("known").isNull()
    joined = spans.join(known, "parent_id", "left")
    up = F.when(~lost, F.col("parent_id"))
    nodes = kept(joined.select("span_id", up.alias("up"), F.when(up.isNull(), F.col("span_id")).alias("root"), F.when(up.isNull(), 0).otherwise(1).alias("depth"), own.alias("tags"), own.alias("own"), F.when(lost, "orphan").alias("issue")), "round-0")
    # up is the next span above that the way has not taken in; depth counts the steps taken so far
    left, number, latest, closed = nodes.where("up is not null").count(), 0, nodes, nodes.where("up is null")
    while left:
        number += 1
        above = nodes.select(F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("tags").alias("over"))
        merged = F.map_zip_with("over", "tags", lambda k, a, b: F.when(F.map_contains_key("tags", k), b).otherwise(a))
        moved = latest.where("up is not null").join(above, "up").select("span_id", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), merged.alias("tags"), "own", "issue")
        latest = kept(moved, f"round-{number}")
        nodes, closed = closed.union(latest), closed.union(latest.where("up is null"))
        still = latest.where("up is not null").count()
        if still == left:
            break
        left = still
    open_ = F.col("up").isNotNull()
    return nodes.select("span_id", "root", F.when(~open_, F.col("depth")).alias("depth"), F.when(open_, F.col("own")).otherwise(F.col("tags")).alias("tags"), F.when(open_, "cycle").otherwise(F.col("issue")).alias("issue"))
