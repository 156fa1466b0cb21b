"""Sources: intake bundles, record files with bad rows kept, weight files, and text of binary documents."""

from __future__ import annotations

import io
import re
import tomllib
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.scoring import COMPONENTS, WEIGHTS

BUNDLE = "package_id string, metadata struct<firm_name:string,fund_name:string,received_at:string,source_channel:string,firm_id:string,fund_id:string,version_date:string>, files array<struct<file_name:string,role:string,source_ref:string,document_id:string>>"


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each bundle file, with ``problem`` set where it is not a JSON object; such files are kept."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    parsed = whole.withColumn("variant", F.try_parse_json("value"))
    is_object = F.startswith(F.schema_of_variant("variant"), F.lit("OBJECT"))
    problem = F.when(F.col("variant").isNull(), "invalid_json").when(~is_object, "not_an_object")
    return parsed.select("file", F.from_json("value", BUNDLE).alias("b"), problem.alias("problem")).select("file", "problem", "b.*")


def ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of files with one JSON object a line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    good = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT"))
    records = lines.where(good).select("file", F.from_json("value", schema).alias("r")).select("file", "r.*")
    return records, lines.where(~F.coalesce(good, F.lit(False)))


def weight_files(spark: SparkSession, folder: str) -> DataFrame:
    """(asset_class, component, position, weight) of the TOML files of a configuration folder, eight small files.

    A file's name must be its class, and every class must be there with all components, weights
    in [0, 1] and a sum of one; otherwise a ValueError names the file.
    """
    rows = []
    for path in sorted(Path(folder).glob("*.toml")):
        data = tomllib.loads(path.read_text())
        name, weights = data.get("asset_class"), data.get("weights", {})
        if name != path.stem or set(weights) != set(COMPONENTS) or not all(0 <= w <= 1 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
            raise ValueError(f"{path.name} is not a valid set of weights")
        rows += [(name, c, k, float(weights[c])) for k, c in enumerate(COMPONENTS)]
    if missing := set(WEIGHTS) - {r[0] for r in rows}:
        raise ValueError(f"no weights for {', '.join(sorted(missing))}")
    return spark.createDataFrame(rows, "asset_class string, component string, position int, weight double")


# The keys of a threshold configuration.
THRESHOLD_KEYS = ("field_auto_accept_min", "key_field_confidence_min", "document_key_field_coverage_min", "mandatory_field_min")
LISTS = ("key_fields", "mandatory_fields")


def threshold_config(text: str) -> tuple[dict[str, object], dict[str, dict[str, object]]]:
    """(base, profiles by document type) of a configuration in the block form of YAML: numbers from 0 to 1, and lists one item a line.

    ValueError for an unknown key, a list in a line, a number out of range, an indent other than
    by twos, a profile without key fields, or a base without all thresholds. Profiles hold what they state only.
    """
    base: dict[str, object] = {}
    profiles: dict[str, dict[str, object]] = {}
    where, items = base, None
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].rstrip()
        if not line:
            continue
        deep, (head, colon, tail) = len(line) - len(line.lstrip()), line.strip().partition(":")
        tail = tail.strip().strip('"')
        if head.startswith("- ") and items is not None and deep in (2, 4, 6) and not colon:
            items.append(head[2:].strip().strip('"'))
            continue
        items = None
        if deep == 0:
            where = base
        elif deep == 2 and colon and not tail and where is not base or deep == 2 and base.get("document_profiles") == "open":
            where = profiles.setdefault(head, {})
            continue
        elif deep != 4 or where is base:
            raise ValueError(f"line {number}: unexpected indent")
        if head == "document_profiles" and deep == 0 and not tail:
            base["document_profiles"] = "open"
            where = profiles
        elif head in LISTS and colon and not tail:
            items = where.setdefault(head, [])
        elif head in THRESHOLD_KEYS and tail:
            value = float(tail)
            if not 0 <= value <= 1:
                raise ValueError(f"line {number}: {head} must be from 0 to 1")
            where[head] = value
        else:
            raise ValueError(f"line {number}: unknown key {head!r}")
        if deep == 0 and head != "document_profiles":
            base.pop("document_profiles", None)
    base.pop("document_profiles", None)
    if missing := [k for k in THRESHOLD_KEYS if k not in base]:
        raise ValueError(f"missing thresholds: {', '.join(missing)}")
    if bare := [k for k, p in profiles.items() if not p.get("key_fields")]:
        raise ValueError(f"profiles without key_fields: {', '.join(bare)}")
    base.setdefault("mandatory_fields", [])
    return base, profiles


def threshold_profiles(spark: SparkSession, text: str) -> DataFrame:
    """(doc_type, key_fields, mandatory_fields, thresholds) of a configuration, with null for what a profile leaves to the base."""
    _, profiles = threshold_config(text)
    names = (*LISTS, *THRESHOLD_KEYS)
    rows = [(kind, *[p.get(k) for k in names]) for kind, p in profiles.items()]
    return spark.createDataFrame(rows, "doc_type string, key_fields array<string>, mandatory_fields array<string>, " + ", ".join(f"{k} double" for k in THRESHOLD_KEYS))


def seed_tables(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The arrays of one JSON object as tables by name, each with its own columns: seeds, corpora and scenarios."""
    whole = spark.read.schema(", ".join(f"{name} array<struct<{columns}>>" for name, columns in schemas.items())).option("multiLine", True).json(path)
    return {name: whole.select(F.inline(name)) for name in schemas}


def expected_fields(samples: DataFrame) -> DataFrame:
    """(document_id, key, value) of samples(document_id, expected), where expected is JSON: an object by key, or a list of objects with key and value."""
    listed = F.startswith(F.trim("expected"), F.lit("["))
    pairs = F.transform(F.map_entries(F.from_json("expected", "map<string,string>")), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    items = F.from_json("expected", "array<struct<key:string,value:string>>")
    return samples.select("document_id", F.inline(F.when(listed, items).otherwise(pairs)))


def fixture_bytes(files: DataFrame) -> DataFrame:
    """files(package_id, file_name, source_ref) with content, the three as lines in UTF-8."""
    lines = F.concat(F.concat_ws("\n", F.col("package_id").cast("string"), "file_name", "source_ref"), F.lit("\n"))
    return files.withColumn("content", F.encode(lines, "UTF-8"))


def _pdf_pages(content: bytes) -> list[str]:
    """The literal strings of a PDF's text streams, one entry a stream; uncompressed streams only."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    pages = []
    for body in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
        texts = [_pdf_literal(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", body, re.DOTALL)]
        if texts:
            pages.append("\n".join(texts))
    return pages


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_literal(raw: bytes) -> str:
    def decoded(m: re.Match) -> bytes:
        own = m[1]
        if own[:1].isdigit():
            return bytes([int(own, 8) & 255])
        return b"" if own in (b"\n", b"\r\n") else _ESCAPES.get(own, own)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", decoded, raw, flags=re.DOTALL).decode("latin-1")


def _pptx_pages(content: bytes) -> list[str]:
    """The text runs of a presentation's slides in the order of their numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "ppt/presentation.xml" not in z.namelist():
            raise ValueError("not a presentation")
        slides = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return ["\n".join(re.findall(r"<a:t>([^<]*)</a:t>", z.read(n).decode("utf-8", "ignore"))) for _, n in slides]


def document_text(files: DataFrame) -> DataFrame:
    """(path, page, text, problem) of files(path, content): PDF streams and slides as pages from 1.

    A file that can't be read gives one row with its problem. Spark lists and deals out the files;
    a task holds one at a time.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = (_pptx_pages if content[:2] == b"PK" else _pdf_pages)(bytes(content))
                    yield pd.DataFrame({"path": path, "page": range(1, len(found) + 1), "text": found, "problem": None})
                except (ValueError, zipfile.BadZipFile, KeyError) as error:
                    yield pd.DataFrame({"path": [path], "page": [0], "text": [None], "problem": [str(error)]})

    return files.select("path", "content").mapInPandas(pages, "path string, page int, text string, problem string")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def ooxml_kind(path: str, content: bytes) -> str:
    """pptx, xlsx, docx or zip, by the members of an archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
    return next((kind for kind, top in (("pptx", "ppt/"), ("xlsx", "xl/"), ("docx", "word/")) if any(n.startswith(top) for n in names)), "zip")
