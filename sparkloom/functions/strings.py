"""String, number and identifier expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Suffixes of legal names that do not tell two firms apart.
LEGAL_SUFFIX = r"([\s,]*\b(llc|l\.l\.c|lp|l\.p|ltd|inc)\.?)+[\s,]*$"


def _fold(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x).casefold()


@pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """NFKC and case folding. Spark has no such form of its own, so an Arrow function does it."""
    return names.map(_fold)


@pandas_udf(ArrayType(StringType()))
def folded_all(names: pd.Series) -> pd.Series:
    """folded for every text of an array."""
    return names.map(lambda own: None if own is None else [_fold(x) for x in own])


def without_suffix(name: Column) -> Column:
    """A folded name with single spaces, without legal suffixes or trailing commas."""
    spaced = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, LEGAL_SUFFIX, ""), r"[\s,]+$", ""))


def normalized_name(name: Column) -> Column:
    """NFKC, case folded, single spaces, no legal suffixes or trailing commas."""
    return without_suffix(folded(name))


def slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def stable_id(preferred: Column, fallback: Column, prefix: str) -> Column:
    """The given id, else prefix_slug of the fallback without legal suffixes."""
    return F.coalesce(F.nullif(F.trim(preferred), F.lit("")), F.concat(F.lit(f"{prefix}_"), slug(normalized_name(fallback))))


def file_extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def magnitude(raw: Column) -> Column:
    """The first number of a text times its suffix (k, m, mm, b, bn or the word); null without a number.

    The suffix must be a token of its own: in "25 bps" there is none.
    """
    text = F.replace(F.lower(raw), F.lit(","), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    suffix = F.regexp_extract(text, r"-?[0-9]+(?:\.[0-9]+)?\s*(k|thousand|mm|million|m|bn|billion|b)(?:[^a-z]|$)", 1)
    scale = F.when(suffix.isin("k", "thousand"), 1e3).when(suffix.isin("m", "mm", "million"), 1e6).when(suffix.isin("b", "bn", "billion"), 1e9).otherwise(1.0)
    return number * scale


def relative_difference_percent(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12)) * 100


def zero_safe_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def safe_cell(text: Column) -> Column:
    """A text that a spreadsheet does not take for a formula."""
    return F.when(F.rlike(text, F.lit(r"^[=+\-@]")), F.concat(F.lit("'"), text)).otherwise(text)
