"""Package intake: validation to an issues table, identities, document types, field extraction, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.strings import file_extension, normalized_name, stable_id

# Domains of the intake contract.
PRIMARY = ("pdf", "pptx")
SUPPORTED = ("pdf", "pptx", "xlsx", "docx", "eml", "txt", "md")
CHANNELS = ("email", "portal_upload", "data_room", "internal_forward", "other")
REQUIRED = ("firm_name", "fund_name", "received_at", "source_channel")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})$"
CONTRACT_VERSION = "v1"
# Document types by keyword, in order of priority.
DOC_TYPES = (("ddq", ("ddq", "due diligence questionnaire")), ("tear_sheet", ("tear sheet", "tearsheet", "fact sheet")), ("monthly_letter", ("monthly letter", "monthly commentary")), ("pitchbook", ("pitchbook", "pitch book")))
# Fields by pattern; the first match of each counts.
FIELD_PATTERNS = (
    ("manager.name", r"(?i)manager\s*[:\-]?\s*([A-Za-z0-9 &/\-]+)", 0.82),
    ("strategy.asset_class", r"(?i)strategy asset class\s*[:\-]?\s*([^;\n]+)", 0.82),
    ("terms.management_fee", r"(?i)management fee\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)?%)", 0.82),
    ("terms.performance_fee", r"(?i)performance fee\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)?%)", 0.82),
    ("performance.net_return_1y", r"(?i)net return 1y\s*[:\-]?\s*([0-9.-]+%)", 0.82),
    ("operations.aum", r"(?i)aum\s*[:\-]\s*([$A-Za-z0-9.]+)", 0.82),
    ("team.key_person_risk", r"(?i)key person risk\s*[:\-]?\s*([^;\n]+)", 0.82),
    ("strategy.name", r"(?i)strategy\s*[:\-]?\s*([A-Za-z0-9 /\-]+)", 0.82),
    ("benchmark.name", r"(?i)benchmark\s*[:\-]?\s*([A-Za-z0-9 &\-/]+)", 0.82),
)
# Fields of PDF text and of slides.
_STRICT = (
    ("strategy.asset_class", r"(?i)strategy asset class\s*[:\-]\s*([^;\n]+)"),
    ("terms.management_fee", r"(?i)management fee\s*[:\-]\s*([0-9]+(?:\.[0-9]+)?%)"),
    ("performance.net_return_1y", r"(?i)net return 1y\s*[:\-]\s*([0-9.-]+%)"),
    ("operations.aum", r"(?i)aum\s*[:\-]\s*([$A-Za-z0-9.]+)"),
    ("team.key_person_risk", r"(?i)key person risk\s*[:\-]\s*([^;\n]+)"),
)
PDF_PATTERNS = tuple((*x, sure) for x, sure in zip(_STRICT, (0.93, 0.91, 0.88, 0.72, 0.50), strict=True))
SLIDE_PATTERNS = tuple((*x, sure) for x, sure in zip(_STRICT, (0.95, 0.93, 0.90, 0.82, 0.80), strict=True))


def valid_received_at(text: Column) -> Column:
    """Whether a text is an ISO date, or a date and time (seconds optional) with a zone, that exists."""
    t = F.trim(text)
    whole = F.regexp_replace(t, r"T(\d{2}:\d{2})(Z|[+-])", "T$1:00$2")
    moment = F.rlike(t, F.lit(ISO_DATETIME)) & F.try_to_timestamp(whole).isNotNull()
    return F.coalesce((F.rlike(t, F.lit(ISO_DATE)) & F.try_to_date(t, "yyyy-MM-dd").isNotNull()) | moment, F.lit(False))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def intake_issues(packages: DataFrame) -> DataFrame:
    """(package_id, code, path, severity) of packages(package_id, metadata struct, files array<struct>), a row for each issue.

    metadata has the required keys and contract_version, schema_revision; a file file_name, role,
    source_ref. A file without a name, or of a type that is not supported, is looked at no further.
    """
    meta = lambda k: F.col(f"metadata.{k}")

    def issue(bad: Column, code: str, path: str | Column, severity: str = "error") -> Column:
        return F.when(bad, F.struct(F.lit(code).alias("code"), (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(severity).alias("severity")))

    there, version = F.col("metadata").isNotNull(), meta("contract_version")
    whole = [issue(~there, "missing_metadata", "metadata")]
    whole += [issue(there & _blank(meta(k)), "missing_required_metadata", f"metadata.{k}") for k in REQUIRED]
    whole += [
        issue(~_blank(meta("source_channel")) & ~F.trim(meta("source_channel")).isin(*CHANNELS), "invalid_source_channel", "metadata.source_channel"),
        issue(there & ~valid_received_at(meta("received_at")), "invalid_received_at", "metadata.received_at"),
        issue(version.isNotNull() & (F.trim(version) == ""), "invalid_contract_version", "metadata.contract_version"),
        issue(~_blank(version) & (F.trim(version) != CONTRACT_VERSION), "unsupported_contract_version", "metadata.contract_version"),
        issue(meta("schema_revision") < 1, "invalid_schema_revision", "metadata.schema_revision"),
        issue(F.coalesce(F.size("files"), F.lit(0)) <= 0, "missing_files", "files"),
        issue((F.size("files") > 0) & ~F.exists("files", lambda f: F.coalesce(file_extension(F.trim(f["file_name"])).isin(*PRIMARY), F.lit(False))), "missing_primary_document", "files"),
    ]

    def of_file(f: Column, k: Column) -> Column:
        at = lambda name: F.concat(F.lit("files["), k.cast("string"), F.lit(f"].{name}"))
        named = f.isNotNull() & ~_blank(f["file_name"])
        known = file_extension(F.trim(f["file_name"])).isin(*SUPPORTED)
        return F.array(
            issue(f.isNull(), "invalid_file_entry", F.concat(F.lit("files["), k.cast("string"), F.lit("]"))),
            issue(f.isNotNull() & _blank(f["file_name"]), "missing_file_name", at("file_name")),
            issue(named & _blank(f["role"]), "missing_file_role", at("role")),
            issue(named & ~known, "unsupported_file_type", at("file_name")),
            issue(named & known & _blank(f["source_ref"]), "missing_source_ref", at("source_ref"), "warning"),
        )

    per_file = F.flatten(F.transform(F.coalesce("files", F.array().cast("array<struct<file_name:string,role:string,source_ref:string>>")), of_file))
    every = F.array_compact(F.concat(F.array(*whole), per_file))
    return packages.select("package_id", F.explode(every).alias("i")).select("package_id", "i.*")


def resolve_entities(names: DataFrame, entities: DataFrame, prefix: str) -> DataFrame:
    """names(name_id, name, given_id) to entities(entity_id, name, aliases): resolved, ambiguous or new.

    A given id stands. Else the normalised name is joined with every normalised legal name and
    alias: one entity is a match, several are ambiguous, none gives prefix_slug of the name.
    """
    known = entities.select("entity_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("alias"))
    known = known.select("entity_id", normalized_name(F.col("alias")).alias("key")).where("key <> ''").distinct()
    groups = known.groupBy("key").agg(F.count("*").alias("matches"), F.min("entity_id").alias("match"))
    joined = names.withColumn("key", normalized_name(F.col("name"))).join(groups, "key", "left")
    given = F.nullif(F.trim("given_id"), F.lit(""))
    status = F.when(given.isNotNull(), "given").when(F.col("matches") > 1, "ambiguous").when(F.col("matches") == 1, "matched").otherwise("new")
    resolved = F.when(status == "ambiguous", None).otherwise(F.coalesce(given, F.col("match"), stable_id(F.lit(None).cast("string"), F.col("name"), prefix)))
    return joined.select("name_id", "name", status.alias("status"), resolved.alias("entity_id"))


def classify_doc_type(text: Column) -> Column:
    """The first type one of whose keywords occurs; null if none does."""
    low = F.lower(text)
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), k) for k, words in DOC_TYPES])


def extract_fields(docs: DataFrame, patterns: tuple = FIELD_PATTERNS) -> DataFrame:
    """(document_id, key, value, confidence, start, snippet) of docs(document_id, content): the first match of each pattern."""
    each = F.array(
        *[
            F.struct(
                F.lit(k).alias("key"),
                F.trim(F.regexp_extract("content", p, 1)).alias("value"),
                F.lit(sure).alias("confidence"),
                F.regexp_instr("content", F.lit(p)).alias("start"),
                F.trim(F.regexp_extract("content", p, 0)).alias("snippet"),
            )
            for k, p, sure in patterns
        ]
    )
    return docs.select("document_id", F.inline(F.filter(each, lambda x: x["start"] > 0)))


def extract_pdf_fields(docs: DataFrame) -> DataFrame:
    """The fields of PDF text, without full stops at their end, and the page: the last "page N" before the match, else 0."""
    found = extract_fields(docs, PDF_PATTERNS).join(docs, "document_id")
    marks = F.regexp_extract_all(F.left("content", F.col("start") - 1), F.lit(r"(?i)\bpage\s+([0-9]+)\b"), 1)
    page = F.coalesce(F.try_element_at(marks, F.lit(-1)).cast("int"), F.lit(0))
    return found.select("document_id", "key", F.regexp_replace("value", r"\.+$", "").alias("value"), "confidence", page.alias("page"))


def extract_slide_fields(slides: DataFrame) -> DataFrame:
    """(document_id, key, value, confidence, slide) of slides(document_id, slide, content): of each key the first slide that has it."""
    each = slides.select(F.struct("document_id", "slide").alias("document_id"), "content")
    found = extract_fields(each, SLIDE_PATTERNS).select("document_id.*", "key", "value", "confidence")
    first = found.groupBy("document_id", "key").agg(F.min(F.struct("slide", "value", "confidence")).alias("x"))
    return first.select("document_id", "key", "x.value", "x.confidence", "x.slide")


def document_versions(arrivals: DataFrame) -> DataFrame:
    """The first arrival of each content under a key: arrivals(document_key, content, received_at, ord)."""
    hashed = arrivals.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    first = hashed.groupBy("document_key", "sha256").agg(F.min(F.struct("received_at", "ord")).alias("first"), F.count("*").alias("arrivals"))
    version = F.row_number().over(Window.partitionBy("document_key").orderBy("first.received_at", "first.ord"))
    return first.select("document_key", "sha256", F.col("first.received_at").alias("received_at"), "arrivals", version.alias("version"), F.concat_ws(":", F.date_format("first.received_at", "yyyy-MM-dd"), F.left("sha256", F.lit(16))).alias("version_id"))
