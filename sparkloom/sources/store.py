"""A content-addressed store of document versions, as Parquet.

    root/blobs/batch=<id>/prefix=<two hex digits>/   (file_hash, content), each content once
    root/index/batch=<id>/                           (document_key, file_name, version_id, ...), each content once a key
    root/commits/                                    (batch, number), written last

A put writes blobs, then the index, then its commit; readers see committed batches only, so a put
that breaks off leaves nothing visible and can be repeated. Putting what is there adds nothing, but
a blob that has gone is written again. Point reads prune by the hash's prefix. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOBS = "file_hash string, content binary, batch string, prefix string"
INDEX = "document_key string, file_name string, version_id string, file_hash string, received_at string, byte_size bigint, ord bigint, batch string"
COMMITS = "batch string, number bigint"


def create(spark: SparkSession, root: str) -> None:
    """An empty store; one that is there stays as it is."""
    for part, schema in (("blobs", "file_hash string, content binary"), ("index", INDEX.removesuffix(", batch string")), ("commits", COMMITS)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{root}/{part}")


def _committed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(COMMITS).parquet(f"{root}/commits")


def _blobs(spark: SparkSession, root: str) -> DataFrame:
    """Committed blobs; a content that two batches hold may stand twice."""
    return spark.read.schema(BLOBS).parquet(f"{root}/blobs").join(_committed(spark, root).select("batch"), "batch", "left_semi")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The versions of every key in the order in which they came: (document_key, file_name, version_id, file_hash, received_at, byte_size, batch_number, ord)."""
    rows = spark.read.schema(INDEX).parquet(f"{root}/index")
    return rows.join(_committed(spark, root), "batch").withColumnRenamed("number", "batch_number").drop("batch")


def put(arrivals: DataFrame, root: str) -> int:
    """Store arrivals(document_key, file_name, content, received_at, ord); the number of versions that are new.

    Of equal contents under a key the first by received_at and ord counts, and none where the key has
    it already, whatever the time. A content is stored once for all keys. Null content is empty. A
    version's id is its time and the first sixteen digits of its hash.
    """
    spark, batch = arrivals.sparkSession, uuid.uuid4().hex
    content = F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary"))
    rows = arrivals.select("document_key", "file_name", F.col("received_at").cast("string").alias("received_at"), F.col("ord").cast("bigint"), content.alias("content"))
    rows = rows.withColumn("file_hash", F.sha2("content", 256))
    light = rows.select("document_key", "file_hash", F.struct("received_at", "ord", "file_name", F.octet_length("content").cast("bigint").alias("byte_size")).alias("x"))
    first = light.groupBy("document_key", "file_hash").agg(F.min("x").alias("x")).select("document_key", "file_hash", "x.*")
    new = first.join(versions(spark, root).select("document_key", "file_hash"), ["document_key", "file_hash"], "left_anti")
    new = new.withColumn("version_id", F.concat("received_at", F.lit(":"), F.left("file_hash", F.lit(16))))
    lacking = rows.select("file_hash", "content").join(_blobs(spark, root).select("file_hash"), "file_hash", "left_anti").dropDuplicates(["file_hash"])
    lacking.withColumn("prefix", F.left("file_hash", F.lit(2))).repartition("prefix").write.partitionBy("prefix").parquet(f"{root}/blobs/batch={batch}")
    new.select(*[n.split()[0] for n in INDEX.removesuffix(", batch string").split(", ")]).write.parquet(f"{root}/index/batch={batch}")
    number = _committed(spark, root).agg(F.coalesce(F.max("number"), F.lit(0)) + 1).head()[0]
    spark.createDataFrame([(batch, number)], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return spark.read.schema(INDEX.removesuffix(", batch string")).parquet(f"{root}/index/batch={batch}").count()


def get(requests: DataFrame, root: str) -> DataFrame:
    """requests(document_key, version_id) with present and content; null content where the version or its blob is not there."""
    spark = requests.sparkSession
    asked = requests.select("document_key", "version_id").distinct()
    known = asked.join(versions(spark, root).select("document_key", "version_id", "file_hash"), ["document_key", "version_id"], "left")
    known = known.withColumn("prefix", F.left("file_hash", F.lit(2)))
    blobs = _blobs(spark, root).select("prefix", "file_hash", "content").dropDuplicates(["prefix", "file_hash"])
    return known.join(blobs, ["prefix", "file_hash"], "left").select("document_key", "version_id", F.col("content").isNotNull().alias("present"), "content")


def get_one(spark: SparkSession, root: str, document_key: str, version_id: str) -> bytes:
    """One content by a read that is pruned to the hash's prefix; KeyError if it is not there."""
    found = versions(spark, root).where((F.col("document_key") == document_key) & (F.col("version_id") == version_id)).head()
    row = found and blob(spark, root, found["file_hash"]).head()
    if not row:
        raise KeyError(f"missing version for document_key={document_key}, version_id={version_id}")
    return bytes(row["content"])


def blob(spark: SparkSession, root: str, file_hash: str) -> DataFrame:
    return _blobs(spark, root).where((F.col("prefix") == file_hash[:2]) & (F.col("file_hash") == file_hash))
