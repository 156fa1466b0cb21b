"""Sinks: snapshots with insert, insert-or-ignore and upsert; exports and manifests.

Parquet has no MERGE, so a table is a folder of snapshots: each write makes the next one, and
readers take the newest that is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.strings import safe_cell


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows; a key that is already there, or twice in the rows, is an error when the result is computed."""
    both = table.unionByName(rows, allowMissingColumns=True)
    n = F.count("*").over(Window.partitionBy(key))
    checked = both.withColumn("_ok", F.when(n > 1, F.raise_error(F.concat(F.lit(f"duplicate {key} "), F.col(key).cast("string")))).otherwise(F.lit(True)))
    return checked.where("_ok").drop("_ok")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows whose key is new, the first by order among equals, are added; the first write wins."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    new = rows.withColumn("_n", first).where("_n = 1").drop("_n").join(table.select(key), key, "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The last write wins for each key; columns in keep stay as the table has them."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    new = rows.withColumn("_n", last).where("_n = 1").drop("_n")
    old = table.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
    new = new.join(old, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).drop(*[f"_{c}" for c in keep])
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update_known(table: DataFrame, rows: DataFrame, keys: list[str], order: Column, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(table updated by the rows whose keys it has, the rows whose keys it has not): an update never adds a row."""
    known = table.select(*keys)
    return upsert(table, rows.join(known, keys, "left_semi"), keys, order, keep), rows.join(known, keys, "left_anti")


def append_numbered(table: DataFrame, rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows appended with the next numbers, in order; a batch of corrections is small."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    return table.unionByName(rows.withColumn("_n", F.row_number().over(Window.orderBy(order))).join(F.broadcast(top)).withColumn(key, F.col("_n") + F.col("_top")).drop("_n", "_top"))


def write_snapshot(table: DataFrame, folder: str, number: int) -> str:
    """A numbered snapshot; it counts from when its number is written among the committed ones, after its rows."""
    path = f"{folder}/v={number:08d}"
    table.write.mode("errorifexists").parquet(path)
    table.sparkSession.range(1).select(F.lit(number).alias("number")).write.mode("append").parquet(f"{folder}/committed")
    return path


def newest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The committed snapshot of the highest number."""
    number = spark.read.parquet(f"{folder}/committed").agg(F.max("number")).head()[0]
    return spark.read.parquet(f"{folder}/v={number:08d}")


def write_csv(rows: DataFrame, path: str) -> None:
    """Text cells are made safe for spreadsheets; numbers are untouched."""
    safe = rows.select(*[safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    safe.write.option("header", True).csv(path)


def write_ndjson(rows: DataFrame, path: str) -> None:
    """One object a line, keys in order."""
    rows.select(*sorted(rows.columns)).write.option("ignoreNullFields", False).json(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256, bytes) of the files of a folder by name; ValueError for a folder whose path goes up."""
    if ".." in folder.split("/"):
        raise ValueError("a manifest's folder must not go up")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy("name")
