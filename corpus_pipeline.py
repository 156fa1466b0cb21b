"""A corpus pipeline over documents: language ID, near-dedup, decontamination, secret scan, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.decontaminate import contaminated
from sparkloom.llm.langid import document_rows, identify, text_model
from sparkloom.llm.minhash import near_duplicates
from sparkloom.llm.mixing import mix
from sparkloom.llm.runtime import split_join, stash, table, unused
from sparkloom.llm.secrets import redact_secrets

BROADCAST_IDS = 1_000_000  # 8 MB


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key, a bigint, is among ids(key); null keys stay. Few ids are broadcast, many joined by a shuffle."""
    ids = stash(ids.select(key).where(F.col(key).isNotNull()).distinct(), "ids")
    kept = docs.join(F.broadcast(ids), key, "left_anti") if ids.count() <= BROADCAST_IDS else split_join(docs, ids, key, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown go: those without letters, and those without a likely language.

    Null and empty texts have no letters and go. Rows are judged each by its own text, language and
    source, so rows that repeat an id, or have none, are kept or dropped each; a tie of languages is
    no reason to drop one. Texts of any length are read whole; other columns may have any names; an
    empty table gives no rows.
    """
    key = unused("row_key", docs.columns)
    lettered = docs.where(F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))).withColumn(key, F.xxhash64("text", "lang", "source"))
    model = text_model(docs.select(F.lower("lang").alias("lang"), "text"))
    rows = lettered.select(F.col(key).alias("doc_id"), "text", "lang", "source")
    found = identify(document_rows(rows), model)
    return without(lettered, found.where(~F.col("accepted")).select(F.col("id").alias(key)), key).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id.

    Null and empty texts are copies of nothing and stay, and so do rows without an id. Of rows that
    repeat an id that stays, one stays: the first by text, those with a text before others, and
    then by all its columns. Texts of any length are read whole; other columns may have any names; an
    empty table gives no rows.
    """
    found = stash(near_duplicates(docs), "near-duplicates")
    once = without(docs, found.where(~F.col("kept")))
    repeated = stash(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return once
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.coalesce(F.trim("text"), F.lit("")) == "", F.col("text"), F.to_json(row))
    again = split_join(once, repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select("row.*")
    return without(once, repeated).union(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go.

    A row goes for its own text, whatever its id: of rows that repeat an id only those that hold an
    item, and rows without an id too. Null and empty texts hold nothing. Texts of any length are
    read whole; other columns may have any names; an empty table gives no rows.
    """
    key = unused("text_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = contaminated(keyed.where("text is not null").select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(keyed, found.select(F.col("doc_id").alias(key)), key).select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; every row stays.

    Null and empty texts stay as they are, and so do other columns of any name. Repeated rows are
    changed alike; overlapping secrets are one; texts of any length are read whole; an empty table
    gives no rows.
    """
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every row as often as its source's rate asks, numbered by copy (_copy if a column has that name).

    A null source is a source of its own. Null and empty texts weigh nothing and are taken at their
    source's rate; rows that repeat an id, or have none, draw alike. An empty table gives no rows.
    """
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

#: The near-duplicate groups need a transitive closure over set similarities, which SQL does not express at this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
