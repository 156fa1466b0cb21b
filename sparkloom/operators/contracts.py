"""Nested JSON records held to a contract, at any depth.

A schema is compiled to a table of rules, one row for a keyword at a place. Records are walked over
VARIANT, one level at a time until no value is left, so a record's depth is not bounded by a type
and every level is a plain generator without a shuffle. The rules then meet the values by a
broadcast join on the place, all in one walk of the records. What is wrong comes out as rows, never as an exception.

A path names a value (``outputs.artifact_ids[2]``); its place is the same with ``[*]`` for every
index, which is where rules stand.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keywords that say nothing about validity.
ANNOTATIONS = {"$schema", "$id", "title", "description", "format", "default", "examples"}
NUMBERS = {"minLength": "string", "maxLength": "string", "minimum": "number", "maximum": "number", "minItems": "array", "maxItems": "array"}
RULES = "place string, rule string, text string, names array<string>, number double"

#: Fixed values of the run contract: sections that may be required, those whose empty value is an answer, and
#: fields that must never carry a payload inline.
SECTIONS = ("cost", "latency", "warnings", "data_quality", "evidence_refs", "identity_refs")
EMPTY_OK = ("warnings", "evidence_refs", "identity_refs")
RAW_FIELDS = ("prompt", "raw_prompt", "raw_output", "model_output", "rows", "result_rows", "document_text", "pii")
#: Participants of these states do not emit yet.
NOT_EMITTING = ("none", "candidate")


def compile_rules(schema: dict[str, Any], place: str = "") -> list[tuple[str, str, str | None, list[str] | None, float | None]]:
    """(place, rule, text, names, number) of a JSON schema: type, const and enum of texts, pattern, bounds, required, closed objects.

    Properties and items go deeper. A keyword that is none of these raises ValueError: a rule that is not
    understood must not pass.
    """
    rules: list[tuple] = []
    for word, value in schema.items():
        if word == "type":
            rules.append((place, "type", None, [value] if isinstance(value, str) else list(value), None))
        elif word in ("const", "enum"):
            names = [value] if word == "const" else list(value)
            if not all(isinstance(x, str) for x in names):
                raise ValueError(f"{place}: {word} is for texts only")
            rules.append((place, word, None, names, None))
        elif word == "pattern":
            rules.append((place, "pattern", value, None, None))
        elif word in NUMBERS:
            rules.append((place, word, None, None, float(value)))
        elif word == "required":
            rules += [(place, "required", name, None, None) for name in value]
        elif word == "properties":
            for name, inner in value.items():
                rules += compile_rules(inner, f"{place}.{name}" if place else name)
        elif word == "items":
            rules += compile_rules(value, f"{place}[*]")
        elif word == "additionalProperties" and isinstance(value, bool):
            if not value:
                rules.append((place, "closed", None, list(schema.get("properties", {})), None))
        elif word not in ANNOTATIONS:
            raise ValueError(f"{place}: the keyword {word} is not known")
    return rules


def rule_table(spark: SparkSession, schema: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame(compile_rules(schema), RULES)


def values(records: DataFrame, key: str, json: str = "json", deepest: int = 32) -> DataFrame:
    """(key, path, place, name, kind, text, number, size, names): every value of records(key, json) at any depth.

    kind is object, array, string, integer, number, boolean, null, or broken for a text that is no
    JSON (null included). text is a string's own, number a number's, size the length of a string or
    an array, names an object's keys. Of deeper nesting than ``deepest`` the level below is not
    read and its parent's kind is deep. Names with dots make paths that read alike, not rules that do.
    """
    spark = records.sparkSession
    level = records.select(key, F.lit("").alias("path"), F.lit("").alias("place"), F.lit(None).cast("string").alias("name"), F.try_parse_json(json).alias("value"))
    levels = [_described(level, key)]
    for depth in range(deepest + 1):
        inner = spark.tvf.variant_explode(F.col("value").outer()).select(F.col("pos"), F.col("key").alias("inner_name"), F.col("value").alias("inner"))
        name, index = F.col("inner_name"), F.col("pos").cast("string")
        joined = lambda at, here: F.when(name.isNull(), F.concat(F.col(at), F.lit("["), here, F.lit("]"))).when(F.col(at) == "", name).otherwise(F.concat(F.col(at), F.lit("."), name))
        level = level.lateralJoin(inner).select(key, joined("path", index).alias("path"), joined("place", F.lit("*")).alias("place"), name.alias("name"), F.col("inner").alias("value"))
        if level.isEmpty():
            break
        levels.append(_described(level, key) if depth < deepest else _described(level, key).withColumn("kind", F.lit("deep")))
    return reduce(DataFrame.unionByName, levels)


def _described(level: DataFrame, key: str) -> DataFrame:
    value = F.col("value")
    raw = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    kind = (
        F.when(value.isNull(), "broken")
        .when(F.is_variant_null(value), "null")
        .when(F.startswith(raw, F.lit("OBJECT")), "object")
        .when(F.startswith(raw, F.lit("ARRAY")), "array")
        .when(raw == "STRING", "string")
        .when(raw == "BOOLEAN", "boolean")
        .when((raw == "BIGINT") | (number == F.floor(number)), "integer")
        .otherwise("number")
    )
    text = F.when(raw == "STRING", F.try_variant_get(value, "$", "string"))
    array = F.when(F.startswith(raw, F.lit("ARRAY")), F.size(F.try_variant_get(value, "$", "array<variant>")))
    names = F.when(F.startswith(raw, F.lit("OBJECT")), F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    measured = F.when(~raw.isin("STRING", "BOOLEAN"), number)
    return level.select(key, "path", "place", "name", kind.alias("kind"), text.alias("text"), measured.alias("number"), F.coalesce(F.length(text), array).alias("size"), names.alias("names"))


def _broken(rule: Column, text: Column, names: Column, limit: Column) -> tuple[Column, Column]:
    """Whether a value breaks a rule, and the detail of that."""
    kind, size, number = F.col("kind"), F.col("size"), F.col("number")
    allowed = F.array_contains(names, kind) | (kind == "integer") & F.array_contains(names, F.lit("number"))
    bound = lambda word, what, held, bad: (rule == word) & what & bad(held)
    counted = kind.isin("integer", "number")
    broken = (
        F.when(kind == "broken", rule == "type")
        .when(rule == "type", ~allowed)
        .when(rule.isin("const", "enum"), ~F.coalesce(F.array_contains(names, F.col("text")), F.lit(False)))
        .when(rule == "pattern", (kind == "string") & ~F.rlike(F.col("text"), text))
        .when(rule == "required", (kind == "object") & ~F.array_contains("names", text))
        .when(rule == "closed", (kind == "object") & (F.size(F.array_except("names", names)) > 0))
        .otherwise(
            bound("minLength", kind == "string", size, lambda x: x < limit)
            | bound("maxLength", kind == "string", size, lambda x: x > limit)
            | bound("minItems", kind == "array", size, lambda x: x < limit)
            | bound("maxItems", kind == "array", size, lambda x: x > limit)
            | bound("minimum", counted, number, lambda x: x < limit)
            | bound("maximum", counted, number, lambda x: x > limit)
        )
    )
    detail = F.when(rule == "required", text).when(rule == "closed", F.array_join(F.array_sort(F.array_except("names", names)), ",")).when(rule == "type", kind).otherwise(F.col("text"))
    return broken, detail


def violations(found: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, path, rule, detail) for each rule that a value breaks; found is of values(). The rules come from one schema and are broadcast."""
    at = found.join(F.broadcast(rules.withColumnsRenamed({"text": "rule_text", "names": "rule_names", "number": "limit"})), "place")
    broken, detail = _broken(F.col("rule"), F.col("rule_text"), F.col("rule_names"), F.col("limit"))
    return at.where(broken).select(key, "path", F.when(F.col("kind") == "broken", "json").otherwise(F.col("rule")).alias("rule"), detail.alias("detail"))


def _filled() -> Column:
    kind = F.col("kind")
    empty = (kind == "null") | (kind == "string") & (F.col("size") == 0) | (kind == "array") & (F.col("size") == 0) | (kind == "object") & (F.size("names") == 0)
    return ~empty


def _payload(fields: tuple[str, ...]) -> Column:
    return F.lower("name").isin(*fields) & _filled()


def raw_payloads(found: DataFrame, key: str, fields: tuple[str, ...] = RAW_FIELDS) -> DataFrame:
    """Fields at any depth whose name, whatever its case, must not carry a payload, and that are not empty."""
    return found.where(_payload(fields)).select(key, "path", F.lit("raw_payload").alias("rule"), F.col("name").alias("detail"))


def sensitive_fields(found: DataFrame, key: str, tokens: tuple[str, ...]) -> DataFrame:
    """Fields at any depth with one of the tokens in their name, whatever its case, filled or not."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("name"), F.lit(t)) for t in tokens])
    return found.where(hit).select(key, "path", F.lit("sensitive_field").alias("rule"), F.col("name").alias("detail"))


def missing_sections(records: DataFrame, key: str, required: DataFrame) -> DataFrame:
    """Sections that required(repo, section) asks of records(key, repo, json): absent (or null), unknown, or empty where that is no answer."""
    fields = F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>")
    wanted = records.select(key, "repo", fields.alias("top")).join(F.broadcast(required), "repo")
    section = F.col("section")
    top = wanted.select(key, section.alias("path"), section.alias("place"), section.alias("name"), F.try_element_at("top", section).alias("value"))
    state = (
        F.when(~F.col("name").isin(*SECTIONS), "section_unknown")
        .when(F.col("kind").isin("broken", "null"), "section_absent")
        .when(~_filled() & ~F.col("name").isin(*EMPTY_OK), "section_empty")
    )
    return _described(top, key).withColumn("rule", state).where("rule is not null").select(key, "path", "rule", F.col("name").alias("detail"))


def manifest_issues(records: DataFrame, key: str, manifests: DataFrame) -> DataFrame:
    """Artifact ids of records(key, json) that the run's manifest(key, artifact_id, sha256) does not list, or lists without a hash; runs without a manifest are not asked."""
    listing = F.try_variant_get(F.try_parse_json("json"), "$.outputs.artifact_ids", "array<variant>")
    place = F.concat(F.lit("outputs.artifact_ids["), F.col("pos").cast("string"), F.lit("]"))
    each = records.select(key, F.posexplode(listing).alias("pos", "value")).where(F.schema_of_variant("value") == "STRING")
    ids = each.select(key, place.alias("path"), F.try_variant_get(F.col("value"), "$", "string").alias("artifact_id"))
    hashed = F.coalesce("sha256", F.lit("")) != ""
    listed = manifests.groupBy(key, "artifact_id").agg(F.max(hashed.cast("int")).alias("hashed"))
    asked = ids.join(manifests.select(key).distinct(), key, "left_semi").join(listed, [key, "artifact_id"], "left")
    rule = F.when(F.col("hashed").isNull(), "not_in_manifest").when(F.col("hashed") == 0, "no_hash_in_manifest")
    return asked.withColumn("rule", rule).where("rule is not null").select(key, "path", "rule", F.col("artifact_id").alias("detail"))


def emitting(records: DataFrame, participants: DataFrame) -> DataFrame:
    """Of records(repo, ...) those whose repo takes part: participants(repo, status) has it with a state that emits. Participants are broadcast, so records are not dealt by a few repos."""
    active = participants.where(F.col("status").isNotNull() & ~F.col("status").isin(*NOT_EMITTING)).select("repo").distinct()
    return records.join(F.broadcast(active), "repo", "left_semi")


def contract_issues(records: DataFrame, key: str, schema: dict[str, Any], participants: DataFrame, required: DataFrame, manifests: DataFrame) -> DataFrame:
    """(key, path, rule, detail): all that is wrong with records(key, repo, json) of participants that emit.

    The schema's rules, payloads inlined at any depth, sections a registry asks for, identities that
    are not of the form type:id, and artifacts that the manifest does not have.
    """
    asked = emitting(records, participants)
    rules = rule_table(records.sparkSession, schema).withColumnsRenamed({"text": "rule_text", "names": "rule_names", "number": "limit"})
    lead = F.row_number().over(Window.partitionBy("place").orderBy("rule", "rule_text")) == 1
    at = values(asked, key).join(F.broadcast(rules.withColumn("lead", lead)), "place", "left")
    # a value has a row for each of its rules, or one without: what is no rule's is asked on the first
    once = F.coalesce("lead", F.lit(True))
    broken, detail = _broken(F.col("rule"), F.col("rule_text"), F.col("rule_names"), F.col("limit"))
    inlined = once & _payload(RAW_FIELDS)
    odd = once & (F.col("place") == "identity_refs[*]") & ((F.col("kind") != "string") | ~F.contains(F.coalesce("text", F.lit("")), F.lit(":")))
    broken = F.col("rule").isNotNull() & broken
    issue = lambda bad, rule, detail: F.when(bad, F.struct(rule.alias("rule"), detail.alias("detail")))
    named = F.when(F.col("kind") == "broken", "json").otherwise(F.col("rule"))
    issues = F.array_compact(F.array(issue(broken, named, detail), issue(inlined, F.lit("raw_payload"), F.col("name")), issue(odd, F.lit("identity"), F.col("text"))))
    asked_of = [F.coalesce(x, F.lit(False)) for x in (broken, inlined, odd)]
    at = at.where(asked_of[0] | asked_of[1] | asked_of[2])
    parts = [
        at.select(key, "path", F.inline(issues)),
        missing_sections(asked, key, required),
        manifest_issues(asked, key, manifests),
    ]
    return reduce(DataFrame.unionByName, parts)
