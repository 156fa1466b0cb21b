"""A sink of its own for JSON records: keys in order, sums in a manifest, visible all at once or not at all.

Under a root are ``data/job-<id>/part-<n>-<id>/``, a folder for each attempt of a task with its files
and their manifest, and ``committed/<batch>.json``, which names the manifests and is written last.
Only what a commit names is read, so failed tasks, broken jobs and lost executors leave nothing
visible; an abort clears what its tasks wrote up to then, and what one still writes after it is
never read. The root may be on any file system that pyarrow and Spark both know; a batch has one
writer at a time.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import islice
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

LINES = "records.ndjson"
ENTRY = "part int, position bigint, path string, sha256 string, bytes bigint, records bigint"
_PLAIN_PATH = re.compile(r"[A-Za-z0-9=_-][A-Za-z0-9._=-]*(/[A-Za-z0-9=_-][A-Za-z0-9._=-]*)*", re.ASCII)
_LISTED = pa.schema([("batch", pa.string()), ("part", pa.int32()), ("position", pa.int64()), ("path", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
_READ = pa.schema([("batch", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("problem", pa.string())])
_COMMIT = "batch string, job string, parts array<struct<files bigint, manifest string, part int, records bigint>>"


def _plain(path: str) -> str:
    if not _PLAIN_PATH.fullmatch(path):
        raise ValueError(f"not a plain relative path: {path!r}")
    return path


@dataclass
class _Part(WriterCommitMessage):
    part: int
    manifest: str
    files: int
    records: int


class _Sum:
    """A file that is written and summed as it grows."""

    def __init__(self, system: pafs.FileSystem, path: str) -> None:
        self.out, self.hash, self.bytes, self.records = system.open_output_stream(path), sha256(), 0, 0

    def add(self, text: str) -> None:
        data = text.encode("ascii")
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)
        self.records += 1


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, batch: str) -> None:
        self.root, self.batch, self.job = root, _plain(batch), f"job-{uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = pafs.FileSystem.from_uri(self.root)
        part = TaskContext.get().partitionId()
        own = f"{self.job}/part-{part:05d}-{uuid4().hex}"
        folder = f"{root}/data/{own}"
        system.create_dir(folder, recursive=True)
        manifest = _Sum(system, f"{folder}/manifest.ndjson")
        lines, records, before = None, 0, ""

        def listed(name: str, found: _Sum) -> None:
            found.out.close()
            entry = {"part": part, "position": manifest.records, "path": f"{own}/{name}", "sha256": found.hash.hexdigest(), "bytes": found.bytes, "records": found.records}
            manifest.add(_compact(entry))

        for batch in iterator:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                records += 1
                record = json.loads(body)
                if path is None:
                    lines = lines or _Sum(system, f"{folder}/{LINES}")
                    lines.add(_compact(record))
                    continue
                if path <= before:
                    raise ValueError(f"a path is there twice or out of order: {path!r}")
                before = path
                name = f"files/{_plain(path)}"
                system.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                file = _Sum(system, f"{folder}/{name}")
                file.add(json.dumps(record, indent=2, sort_keys=True) + "\n")
                listed(name, file)
        if lines:
            listed(LINES, lines)
        manifest.out.close()
        return _Part(part, f"{own}/manifest.ndjson", manifest.records, records)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.root)
        parts = sorted((m for m in messages if isinstance(m, _Part)), key=lambda m: m.part)
        record = {"batch": self.batch, "job": self.job, "parts": [vars(m) for m in parts]}
        final = f"{root}/committed/{self.batch}.json"
        _absent(system, final, self.batch)
        system.create_dir(final.rsplit("/", 1)[0], recursive=True)
        draft = f"{root}/committed/.{self.job}"
        with system.open_output_stream(draft) as out:
            out.write(_compact(record).encode("ascii"))
        system.move(draft, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.root)
        folder = f"{root}/data/{self.job}"
        if system.get_file_info(folder).type != pafs.FileType.NotFound:
            system.delete_dir(folder)


def _compact(record: Any) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":")) + "\n"


def _absent(system: pafs.FileSystem, commit: str, batch: str) -> None:
    if system.get_file_info(commit).type != pafs.FileType.NotFound:
        raise ValueError(f"batch {batch!r} is already committed")


class RecordSink(DataSource):
    """Format ``sorted_records`` with options root and batch, for rows (path, body) with JSON in body.

    A row without a path is a line of its part's NDJSON file, in the order of the rows; one with a
    path is a file of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "sorted_records"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        root, batch = self.options["root"], self.options["batch"]
        system, folder = pafs.FileSystem.from_uri(root)
        _absent(system, f"{folder}/committed/{_plain(batch)}.json", batch)
        return _Writer(root, batch)


def _save(rows: DataFrame, root: str, batch: str) -> None:
    rows.sparkSession.dataSource.register(RecordSink)
    rows.write.format("sorted_records").option("root", root).option("batch", batch).mode("append").save()


def write_lines(rows: DataFrame, root: str, batch: str, problem: Column | None = None) -> None:
    """Every row as an object on a line, keys in order at every depth, nulls kept, letters beyond ASCII escaped.

    The lines of the parts, one part after another, are in the order of rows. A row whose problem is
    not null fails the write with that text, and nothing of the batch is visible. An empty table
    commits a batch without files. A batch that is already there is an error.
    """
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    if problem is not None:
        body = F.when(problem.isNull(), body).otherwise(F.raise_error(problem))
    _save(rows.select(F.lit(None).cast("string").alias("path"), body.alias("body")), root, batch)


def write_files(files: DataFrame, root: str, batch: str) -> None:
    """Every row of files(path, body) as a JSON file of its own, keys in order; a path that is null or there twice fails the write.

    Rows are dealt by path to a fixed number of tasks, as a small row costs a whole file, so the cluster
    shares any number of files and equal paths meet in one task.
    """
    path = F.when(F.col("path").isNull(), F.raise_error(F.lit("a file has no path"))).otherwise(F.col("path"))
    _save(files.select(path.alias("path"), "body").repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path").sortWithinPartitions("path"), root, batch)


def _commits(spark: SparkSession, root: str) -> DataFrame:
    system, folder = pafs.FileSystem.from_uri(root)
    if system.get_file_info(f"{folder}/committed").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).option("recursiveFileLookup", "true").json(f"{root}/committed")


def _relative() -> Column:
    return F.regexp_extract("_metadata.file_path", "^.*/data/(job-[0-9a-f]{32}/.*)$", 1)


def merged_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(batch, part, position, path, sha256, bytes, records) of every committed file.

    Manifests of many batches are joined end to end: by batch, part and position, each in its own order.
    """
    commits = _commits(spark, root)
    named = commits.select("batch", F.explode("parts").alias("part")).where("part.files > 0")
    tasks = spark.sparkContext.defaultParallelism
    manifests = named.select("batch", F.col("part.manifest").alias("manifest")).repartition(tasks, "manifest")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pafs.FileSystem.from_uri(root)
        for found in batches:
            for batch, manifest in zip(found.column("batch").to_pylist(), found.column("manifest").to_pylist(), strict=True):
                with system.open_input_stream(f"{folder}/data/{manifest}") as file:
                    for lines in _pieces(io.BufferedReader(file), 10_000):
                        yield pa.Table.from_pylist([{"batch": batch, **json.loads(x)} for x in lines], schema=_LISTED).combine_chunks().to_batches()[0]

    return manifests.mapInArrow(listed, f"batch string, {ENTRY}")


def _pieces(lines: Iterable[bytes], n: int) -> Iterator[list[bytes]]:
    lines = iter(lines)
    while piece := list(islice(lines, n)):
        yield piece


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(batch, path, line) of every committed record line."""
    listed = merged_manifest(spark, root).where(F.col("path").endswith(f"/{LINES}")).select("batch", "path")
    jobs = [f"{root}/data/{r['job']}" for r in _commits(spark, root).where("size(parts) > 0").select("job").collect()]
    if not jobs:
        return spark.createDataFrame([], "batch string, path string, line string")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", LINES).text(jobs)
    return lines.select(_relative().alias("path"), F.col("value").alias("line")).join(listed, "path").select("batch", "path", "line")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(batch, path, content, problem) of every committed file: ``missing`` or ``changed`` where it is not as its manifest says.

    Tasks open the files that the manifests name, so no folder is listed.
    """
    rows = merged_manifest(spark, root).select("batch", "path", "sha256").repartition(spark.sparkContext.defaultParallelism * 4, "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                content, problem = None, "missing"
                try:
                    with system.open_input_stream(f"{folder}/data/{row['path']}") as file:
                        content = file.read()
                    problem = None if sha256(content).hexdigest() == row["sha256"] else "changed"
                except FileNotFoundError:
                    pass
                yield pa.RecordBatch.from_pylist([{"batch": row["batch"], "path": row["path"], "content": content, "problem": problem}], schema=_READ)

    return rows.mapInArrow(read, "batch string, path string, content binary, problem string")
