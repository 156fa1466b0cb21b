"""Queries over binary files, the document store and the record sink: archives and PDF files of customers, versions of documents, records of orders and suppliers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.plans.registry import query, shared_folder
from sparkloom.sources import pictures, records, store
from sparkloom.sources.tables import table

_ENDINGS = ("png", "JPEG", "svg", "emf")
_RELS = "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>"
_IMAGE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"


def visual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A presentation, PDF or other file of each customer: (document_id, file_name, content)."""
    # a small row makes a whole file, so rows are dealt before that
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).repartition(spark.sparkContext.defaultParallelism * 4, "key")
    ending = f"element_at(array({', '.join(map(repr, _ENDINGS))}), int((j + key) % 4) + 1)"
    link = f"concat('<Relationship Id=\"rId', j, '\" Type=\"{_IMAGE}\" Target=\"../media/p', j, '.', {ending}, '\"/>')"
    slides = F.expr("sequence(1, int(key % 3) + 1)")
    rels = F.expr(f'''transform(sequence(1, int(key % 3) + 1), k -> encode(concat("{_RELS}", array_join(transform(filter(array(2, 1), j -> j <= (k + key) % 3), j -> {link}), ''), '<Relationship Id="rId9" Type="x/slideLayout" Target="../l.xml"/></Relationships>'), 'UTF-8'))''')
    media = "filter(array(1, 2), j -> (key + j) % 5 <> 0)"
    names = F.concat(F.transform(slides, lambda k: F.concat(F.lit("ppt/slides/_rels/slide"), k.cast("string"), F.lit(".xml.rels"))), F.expr(f"transform({media}, j -> concat('ppt/media/p', j, '.', {ending}))"))
    contents = F.concat(rels, F.expr(f"transform({media}, j -> encode(concat(name, ':', j), 'UTF-8'))"))
    pdf = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Page /XObject << /Im0 6 0 R /Im1 5 0 R /Im2 6 0 R >> >>\nendobj\n5 0 obj\n<< /Subtype /Image /Filter /DCTDecode >>\nstream\n"),
        "name",
        F.lit("\nendstream\nendobj\n6 0 obj\n<< /Subtype /Image /Filter /JPXDecode >>\nstream\njp2 "),
        "name",
        F.lit("\nendstream\nendobj\n7 0 obj\n<< /Subtype /Image /Filter /FlateDecode /ColorSpace 8 0 R >>\nstream\nink\nendstream\nendobj\n8 0 obj\n[/DeviceCMYK]\nendobj\n%%EOF"),
    )
    kind = F.col("key") % 7
    zipped = pictures.archives(rows.where(kind < 3).select(F.col("key").alias("document_id"), names.alias("names"), contents.alias("contents"))).select("document_id", F.lit(".PPTX").alias("ending"), "content")
    plain = rows.where(kind >= 3).select("key", F.when(kind < 5, ".pdf").when(kind == 5, ".pptx").otherwise(".docx").alias("ending"), F.when(kind < 5, F.encode(pdf, "UTF-8")).otherwise(F.encode(F.lit("PK broken"), "UTF-8")).alias("content"))
    return zipped.union(plain).select("document_id", F.concat(F.lit("deck"), F.col("document_id").cast("string"), "ending").alias("file_name"), "content")


_PICTURES_SQL = f"""c AS (SELECT c_custkey AS key, c_name AS name FROM customer),
s AS (SELECT key, name, unnest(range(1, key % 3 + 2)) AS slide FROM c WHERE key % 7 < 3),
p AS (SELECT key, name, slide, j, [{', '.join(map(repr, _ENDINGS))}][CAST((j + key) % 4 + 1 AS INTEGER)] AS ending FROM s, (VALUES (1), (2)) t(j) WHERE j <= (slide + key) % 3 AND (key + j) % 5 <> 0),
f AS (SELECT key AS document_id, NULL AS page, slide, 'rId' || j AS ref, 'ppt/media/p' || j || '.' || ending AS target, CASE lower(ending) WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS media_type, name || ':' || j AS content, NULL AS reason FROM p
  UNION ALL SELECT key, 1, NULL, 'pdf-object-5', NULL, 'image/jpeg', name, NULL FROM c WHERE key % 7 IN (3, 4)
  UNION ALL SELECT key, 1, NULL, 'pdf-object-6', NULL, 'image/jp2', 'jp2 ' || name, 'unsupported_encoding' FROM c WHERE key % 7 IN (3, 4)
  UNION ALL SELECT key, 0, NULL, 'pdf-object-7', NULL, 'application/octet-stream', 'ink', 'unsupported_colorspace' FROM c WHERE key % 7 IN (3, 4)),
h AS (SELECT *, sha256(content) AS sha256 FROM f)
"""


@query(f"""WITH {_PICTURES_SQL} SELECT document_id, page, slide, ref, target, media_type, strlen(content) AS bytes, sha256, reason, NULL AS problem,
  'va_' || left(sha1(document_id || '|' || CASE WHEN slide IS NULL THEN 'p' || page ELSE 's' || slide END || '|' || ref || '|' || sha256), 16) AS artifact_id,
  CASE WHEN slide IS NULL THEN 'artifacts/' || document_id || '/pdf/page-' || page || '/' || replace(ref, 'pdf-', '') || '.' || CASE media_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/jp2' THEN 'jp2' ELSE 'bin' END ELSE 'artifacts/' || document_id || '/pptx/slide-' || slide || '/' || split_part(target, '/', -1) END AS storage_path FROM h
UNION ALL SELECT key, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN key % 7 = 5 THEN 'BadZipFile: File is not a zip file' ELSE 'unsupported visual source type: .docx' END, NULL, NULL FROM c WHERE key % 7 > 4""")
def picture_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.pictures(visual_files(spark, sf_dir))


@query("SELECT c_custkey AS document_id, CASE WHEN c_custkey % 7 < 3 THEN 'pptx' END AS kind FROM customer")
def office_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_files(spark, sf_dir).select("document_id", pictures.office_kind(F.col("content")).alias("kind"))


_ARRIVALS_SQL = "a AS (SELECT coalesce(source, '') AS document_key, coalesce(text, '') AS content, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS received_at, doc_id AS ord FROM documents)"


@query(f"""WITH {_ARRIVALS_SQL}, h AS (SELECT *, sha256(content) AS file_hash FROM a),
one AS (SELECT document_key, file_hash, min((received_at, ord)) AS x FROM h WHERE ord % 3 <> 0 GROUP BY 1, 2),
two AS (SELECT document_key, file_hash, min((received_at, ord)) AS x FROM h ANTI JOIN one USING (document_key, file_hash) GROUP BY 1, 2),
v AS (SELECT *, 1 AS batch FROM one UNION ALL SELECT *, 2 FROM two),
n AS (SELECT document_key, file_hash, x[1] AS received_at, x[2] AS ord, row_number() OVER (PARTITION BY document_key ORDER BY batch, x[1], x[2]) AS version FROM v)
SELECT n.document_key, 'doc' || n.ord AS file_name, n.received_at || ':' || left(file_hash, 16) AS version_id, file_hash, CAST(version AS INTEGER) AS version, CAST(strlen(content) AS BIGINT) AS byte_size, true AS present, true AS intact
FROM n JOIN a ON a.ord = n.ord""")
def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two puts that overlap, then every version read back by its id."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    key = F.col("doc_id")
    at = F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))
    arrivals = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("document_key"), F.concat(F.lit("doc"), key.cast("string")).alias("file_name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), at.alias("received_at"), key.alias("ord"))
    store.create(spark, root)
    store.put(arrivals.where("ord % 3 <> 0"), root)
    store.put(arrivals, root)
    rows = store.versions(spark, root)
    version = F.row_number().over(Window.partitionBy("document_key").orderBy("batch_number", "received_at", "ord"))
    content = store.get(rows, root).select("document_key", "version_id", "present", F.sha2("content", 256).alias("read"))
    out = rows.withColumn("version", version).join(content, ["document_key", "version_id"])
    return out.select("document_key", "file_name", "version_id", "file_hash", "version", "byte_size", "present", (F.col("read") == F.col("file_hash")).alias("intact"))


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS batch,
  '{"customer":{"band":' || coalesce('"' || o_orderpriority || '"', 'null') || ',"key":' || o_custkey || '},"order":' || o_orderkey || ',"units":' || CAST(floor(o_totalprice) AS BIGINT) || '}' AS line
FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of orders as records with sorted keys; a record without a customer or price would fail its batch."""
    root = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    closed = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    orders = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL AND o_totalprice IS NOT NULL")
    record = [F.floor("o_totalprice").alias("units"), F.col("o_orderkey").alias("order"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("band")).alias("customer")]
    missing = F.when(F.col("customer.key").isNull() | F.col("units").isNull(), F.concat(F.lit("incomplete record of order "), F.col("order").cast("string")))
    for batch, rows in (("closed", orders.where(closed)), ("open", orders.where(~closed))):
        records.write_lines(rows.select(*record), root, batch, missing)
    return records.read_lines(spark, root).select("batch", "line")


@query("""WITH f AS (SELECT s_suppkey, '{' || chr(10) || '  "name": ' || coalesce('"' || s_name || '"', 'null') || ',' || chr(10) || '  "nation": ' || coalesce(CAST(s_nationkey AS VARCHAR), 'null') || chr(10) || '}' || chr(10) AS body FROM supplier)
SELECT 'suppliers' AS batch, 'files/s' || s_suppkey || '/run.json' AS name, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS bytes, true AS intact FROM f""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, held against the merged manifest."""
    root = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    body = F.to_json(F.struct(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")), {"ignoreNullFields": "false"})
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/run.json")).alias("path"), body.alias("body"))
    records.write_files(rows, root, "suppliers")
    read = records.read_files(spark, root).select("batch", "path", F.col("problem").isNull().alias("intact"))
    listed = records.merged_manifest(spark, root).join(read, ["batch", "path"])
    return listed.select("batch", F.regexp_extract("path", "files/.*$", 0).alias("name"), "sha256", "bytes", "intact")
