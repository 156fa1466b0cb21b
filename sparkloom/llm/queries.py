"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown import class_model_scores
from .chatformat import FORMAT_SQL, format_turns, hostile_turns, read_back
from .decontaminate import contaminated
from .fingerprint import edited_fingerprints
from .langid import document_rows, identify, page_rows, text_model
from .linkrank import judge_urls
from .minhash import near_duplicates
from .mixing import MIX_SQL, mix_report
from .pii import find_pii
from .repair import damaged, repair_report
from .runtime import crc_mod, table
from .secrets import scan_secrets
from .spelling import document_variants
from .toxicity import toxicity_scores


def op1_brown_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and every page."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = text_model(docs.select(F.lower("lang").alias("lang"), "text"))
    of_docs = identify(document_rows(docs), model).withColumns({"doc_id": F.col("id"), "page_id": F.lit(None).cast("bigint")})
    of_pages = identify(page_rows(pages), model).withColumns({"doc_id": F.lit(None).cast("bigint"), "page_id": F.col("id")})
    columns = ["doc_id", "page_id", "declared", "suffix", "host", "letters", "lang", "posterior", "accepted"]
    return of_docs.select(columns).union(of_pages.select(columns))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) == 2)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_variants(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(conversations.unionByName(hostile_turns(spark))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_brown_lm_scores,
        op2_source_mix,
        op3_language_id,
        op4_benchmark_decontamination,
        op5_pii_weak_supervision,
        op6_url_trust,
        op7_toxicity,
        op8_secret_scan,
        op9_multiset_fingerprint,
        op10_minhash_near_dedup,
        op11_conversation_repair,
        op12_spelling_variants,
        op13_chat_format,
    )
}

ORACLES: dict[str, str] = {"op2_source_mix": MIX_SQL, "op13_chat_format": FORMAT_SQL}
