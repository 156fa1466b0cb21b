"""Types of documents by a dictionary of aliases: the n-grams that its first tokens begin are joined with it, so 10,000 aliases need no 10,000 patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What turns a name that ends with an alias into another one.
NEGATIONS = ("no", "non", "not")

BLOCK = 4096  # tokens whose n-grams are made at once
HEADS = 1 << 18  # so many first tokens, and so many ids, are broadcast at most


def identifier(value: Column) -> Column:
    """A library id in lower case, trimmed, with _ for hyphens and spaces and without the prefix stub_."""
    return F.regexp_replace(F.translate(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), "- ", "__"), "^stub_", "")


def _longest(names: DataFrame, column: str, separator: str) -> int:
    return names.agg(F.max(F.size(F.split(column, separator)))).head()[0] or 0


def id_types(ids: DataFrame, aliases: DataFrame, by: str = "library_id") -> DataFrame:
    """ids with kind: that of the alias that the id is, or else of the first alias(alias, kind, ord) that it starts or ends with.

    Aliases are compared token by token, and an id must have more tokens than the alias it starts or
    ends with. An end does not count if no, non or not stands before it. Ids that are null or fit no
    alias have a null kind. Each distinct id is looked up once, by a join on its beginnings and ends.
    """
    whole = identifier(F.col(by))
    tokens = F.filter(F.split(whole, "_"), lambda t: t != "")
    n, most = F.size(tokens), F.lit(_longest(aliases, "alias", "_"))
    lengths = F.when((n > 1) & (most > 0), F.sequence(F.lit(1), F.least(most, n - 1)))
    joined = lambda start, k: F.array_join(F.slice(tokens, start, k), "_")
    denied = lambda k: F.arrays_overlap(F.slice(tokens, 1, n - k), F.array(*[F.lit(x) for x in NEGATIONS]))
    starts = F.transform(lengths, lambda k: joined(F.lit(1), k))
    ends = F.transform(lengths, lambda k: F.when(~denied(k), joined(n - k + 1, k)))
    parts = F.array_compact(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (starts, ends)]))
    tried = F.concat(F.array(F.struct(F.lit(0).alias("tier"), whole.alias("alias"))), F.transform(parts, lambda a: F.struct(F.lit(1).alias("tier"), a.alias("alias"))))
    names = ids.select(by).where(F.col(by).isNotNull()).distinct()
    found = names.select(by, F.inline(tried)).join(aliases.select("alias", "kind", "ord"), "alias")
    return ids.join(found.groupBy(by).agg(F.min_by("kind", F.struct("tier", "ord")).alias("kind")), by, "left")


def _terms(library: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, kind, ord) of the ids with a kind; a term is its parts with single spaces between."""
    typed = id_types(library, aliases).where(F.col("kind").isNotNull())
    return typed.select(F.trim(F.regexp_replace(identifier(F.col("library_id")), r"[\s_-]+", " ")).alias("term"), "kind", "ord").where("term <> ''")


def _grams(docs: DataFrame, heads: DataFrame | None, lengths: list[int]) -> DataFrame:
    """(document_id, term): the runs of tokens a-z and 0-9 with only blanks, hyphens and underscores between, of the lengths that heads(head, lengths) has for the first of them.

    Other signs are items of their own, which no term has. Without heads, every token begins a run of each of lengths.
    A text is cut into blocks of items that overlap, so that no array beside a token grows with it. The explodes are
    outer ones, as for the others Spark adds a filter that makes the items a second time.
    """
    items = docs.select("document_id", F.regexp_extract_all(F.lower("content"), F.lit(r"[a-z0-9]+|[^\s_-]"), F.lit(0)).alias("items"))
    starts = F.explode_outer(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("items")), F.lit(BLOCK)))
    blocks = items.select("document_id", "items", starts.alias("start")).select("document_id", F.slice("items", F.col("start"), BLOCK + max(lengths, default=1) - 1).alias("items"))
    tokens = blocks.select("document_id", "items", F.posexplode_outer("items").alias("at", "head")).where(F.col("at") < BLOCK)
    if heads is None:
        begun = tokens.where(F.rlike("head", F.lit("^[a-z0-9]"))).withColumn("lengths", F.array(*[F.lit(k) for k in lengths]))
    else:
        begun = tokens.join(F.broadcast(heads), "head")
    run = F.array_join(F.slice("items", F.col("at") + 1, F.col("k")), " ")
    return begun.select("document_id", "items", "at", F.explode("lengths").alias("k")).select("document_id", run.alias("term"))


def text_types(docs: DataFrame, library: DataFrame, aliases: DataFrame, folder: str | None = None, most: int = HEADS) -> DataFrame:
    """(document_id, kind) of every row of docs(document_id, content): the kind of the first id of library(library_id, ord) that stands in it.

    An id stands in a text if its parts do, in order and as whole tokens, with blanks, hyphens or
    underscores between. Ids without a kind do not count; texts that are null, empty or without an id
    have a null kind. An id with other signs than a-z and 0-9 inside is found by its first token and
    then tested by its pattern; one that has none of these is never found. Letters are lowered, not
    case-folded. document_id is unique. Up to most first tokens are broadcast, so that only tokens that
    begin an id make rows, and so are up to most ids; beyond that all runs of tokens are shuffled.
    Library, aliases and the terms made of them are written to folder, which all executors share: else
    each use makes them again, and Spark moves the tests of terms below what makes the ids distinct.
    """
    place = f"{folder}/terms-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        if not folder:
            return df
        df.write.parquet(f"{place}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{place}/{name}")

    library, aliases = kept(library.select("library_id", "ord"), "library"), kept(aliases.select("alias", "kind", "ord"), "aliases")
    terms = _terms(library, aliases).withColumn("odd", ~F.rlike("term", F.lit("^[a-z0-9 ]+$"))).withColumn("first", F.regexp_extract("term", "[a-z0-9]+", 0))
    keyed = terms.select(F.when(F.col("odd"), F.col("first")).otherwise(F.col("term")).alias("term"), "kind", "ord", F.when(F.col("odd"), F.col("term")).alias("literal")).where("term <> ''")
    keyed = kept(keyed.groupBy("term", "literal").agg(F.min_by("kind", "ord").alias("kind"), F.min("ord").alias("ord")), "terms")
    begins = keyed.select(F.split_part("term", F.lit(" "), F.lit(1)).alias("head"), F.size(F.split("term", " ")).alias("k"), "literal")
    heads = begins.groupBy("head").agg(F.collect_set("k").alias("lengths"), F.count("*").alias("ids"), F.count("literal").alias("odd"))
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    n_heads, n_ids, n_odd, lengths = heads.agg(F.count("*"), total("ids"), total("odd"), F.array_distinct(F.flatten(F.collect_set("lengths")))).head()
    grams = _grams(docs, heads.select("head", "lengths") if n_heads <= most else None, lengths)
    hits = grams.join(F.broadcast(keyed) if n_ids <= most else keyed, "term")
    found = hits.where("literal is null").select("document_id", "kind", "ord")
    if n_odd:
        pattern = F.concat(F.lit("(?<![a-z0-9])"), F.replace(F.regexp_replace("literal", "([^a-z0-9 ])", r"\\$1"), F.lit(" "), F.lit(r"[\s_-]+")), F.lit("(?![a-z0-9])"))
        tested = hits.where("literal is not null").select("document_id", "kind", "ord", "literal").distinct().join(docs.select("document_id", "content"), "document_id").where(F.rlike(F.lower("content"), pattern))
        found = found.union(tested.select("document_id", "kind", "ord"))
    first = found.groupBy("document_id").agg(F.min_by("kind", "ord").alias("kind"))
    return docs.select("document_id").join(first, "document_id", "left")
