"""Queries on types by aliases; names of parts stand for library ids, documents for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import aliases
from sparkloom.plans.registry import query, shared_folder
from sparkloom.sources.tables import table

_NAMES_SQL = """names AS (SELECT DISTINCT p_name FROM part),
aliases AS (SELECT DISTINCT alias, kind FROM (SELECT replace(p_name, ' ', '_') AS alias, 'name:' || p_name AS kind FROM names UNION ALL SELECT split_part(p_name, ' ', 2), 'noun:' || split_part(p_name, ' ', 2) FROM names))"""


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    pairs = F.array(F.struct(F.translate("p_name", " ", "_").alias("alias"), F.concat(F.lit("name:"), "p_name").alias("kind")), F.struct(noun.alias("alias"), F.concat(F.lit("noun:"), noun).alias("kind")))
    return names.select(F.inline(pairs)).distinct().withColumn("ord", F.col("alias"))


@query(f"""WITH {_NAMES_SQL}, ids AS (SELECT p_partkey, regexp_replace(replace(replace(lower(trim(CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' stub_' || p_name WHEN 2 THEN p_name || '-template' WHEN 3 THEN 'my ' || p_name WHEN 4 THEN 'not a ' || p_name ELSE 'xx_' || p_name || '_yy' END)), '-', '_'), ' ', '_'), '^stub_', '') AS n FROM part),
tried AS (SELECT p_partkey, kind, alias, CASE WHEN n = alias THEN 0 ELSE 1 END AS tier FROM ids JOIN aliases ON n = alias OR starts_with(n, alias || '_') OR ends_with(n, '_' || alias) AND NOT regexp_matches('_' || left(n, length(n) - length(alias) - 1) || '_', '_(no|non|not)_'))
SELECT p_partkey, kind FROM ids LEFT JOIN (SELECT p_partkey, arg_min(kind, (tier, alias)) AS kind FROM tried GROUP BY 1) USING (p_partkey)""")
def alias_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written in six ways: alone, with a prefix, with tokens before or after, denied, and in the middle."""
    name, key = F.col("p_name"), F.col("p_partkey") % 6
    forms = F.when(key == 0, F.upper(name)).when(key == 1, F.concat(F.lit(" stub_"), name)).when(key == 2, F.concat(name, F.lit("-template"))).when(key == 3, F.concat(F.lit("my "), name))
    forms = forms.when(key == 4, F.concat(F.lit("not a "), name)).otherwise(F.concat(F.lit("xx_"), name, F.lit("_yy")))
    ids = table(spark, sf_dir, "part").select("p_partkey", forms.alias("library_id"))
    return aliases.id_types(ids, _aliases(spark, sf_dir)).select("p_partkey", "kind")


@query(f"""WITH {_NAMES_SQL}, texts AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' The ' || p_name || '.' WHEN 2 THEN upper(replace(p_name, ' ', ' - _')) ELSE '; ' || replace(p_name, ' ', '; ') || 'x' END) AS t FROM documents LEFT JOIN part ON p_partkey = doc_id),
hits AS (SELECT doc_id, min(p_name) AS first FROM texts JOIN names ON regexp_matches(t, '(?:^|[^a-z0-9])' || replace(p_name, ' ', '[\\s_-]+') || '(?:[^a-z0-9]|$)') GROUP BY 1)
SELECT doc_id AS document_id, 'name:' || first AS kind FROM texts LEFT JOIN hits USING (doc_id)""")
def library_text_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library is all names of parts; a text ends with one that counts, with another spelling of it, or with none."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name, key = F.col("p_name"), F.pmod("doc_id", F.lit(4))
    tail = F.when(key == 0, "").when(key == 1, F.concat(F.lit(" The "), name, F.lit("."))).when(key == 2, F.upper(F.replace(name, F.lit(" "), F.lit(" - _")))).otherwise(F.concat(F.lit("; "), F.replace(name, F.lit(" "), F.lit("; ")), F.lit("x")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(parts, F.col("doc_id") == F.col("p_partkey"), "left").select(F.col("doc_id").alias("document_id"), F.concat(F.coalesce("text", F.lit("")), tail).alias("content"))
    library = parts.select("p_name").distinct().select(F.concat(F.lit("stub_"), F.translate("p_name", " ", "-")).alias("library_id"), F.col("p_name").alias("ord"))
    return aliases.text_types(docs, library, _aliases(spark, sf_dir), shared_folder(spark))
