"""Text classifiers: injection guard, visual previews, return-series notes, redaction, prose lines and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of the injection guard, the first that matches counts.
INJECTION = (
    ("INSTRUCTION_OVERRIDE", r"(?is)\b(ignore|disregard|forget)\b.{0,40}\b(previous|above|earlier)\b.{0,40}\b(instructions|directives|rules|messages)\b"),
    ("SYSTEM_PROMPT_EXFILTRATION", r"(?is)\b(reveal|show|print|leak|expose)\b.{0,40}\b(system|developer)\b.{0,40}\b(prompt|message|instructions)\b"),
    ("ROLE_CONFUSION", r"(?is)(\byou are now\b.{0,20}\b(dan|developer|system|root|admin)\b|\bdo anything now\b|<\s*system\s*>|</\s*system\s*>|\[\s*system\s*\]|begin\s+system\s+prompt)"),
    ("ENCODED_INSTRUCTIONS", r"(?is)\b(base64|rot13|hex|url-?decode)\b.{0,30}\b(decode|payload|instructions)\b"),
    ("TOOL_INJECTION", r"(?is)(\bfunction_call\b|\btool_calls?\b|<\s*tool\s*>|</\s*tool\s*>|\bassistant\s+to=\w+\b)"),
)
# Terms of the visual classifier.
INFORMATIVE = (
    "alpha", "attribution", "benchmark", "bps", "chart", "correlation", "drawdown", "exposure", "gross", "index", "monthly",
    "performance", "portfolio", "return", "returns", "risk", "sector", "sharpe", "table", "volatility", "ytd",
)
BOILERPLATE = ("all rights reserved", "confidential", "copyright", "disclaimer", "for institutional use", "for professional investors", "logo", "not an offer", "terms of use", "trademark")
# Signs of a chart, words, and names of pictures that are seldom informative.
CHART = r"(?i)\b(?:q[1-4]|20\d{2}|fy\d{2})\b|(?<![A-Za-z0-9])-?[0-9]+(?:\.[0-9]+)?%"
TOKEN = r"[a-zA-Z][a-zA-Z0-9_%.-]*"
#: So many tokens from the start of a text; what follows them is not read.
TOKENS = r"^(?:[^a-zA-Z]*+[a-zA-Z][a-zA-Z0-9_%%.-]*+){%d}"
LOGO_MARKERS = ("logo", "banner", "footer", "masthead")
PREVIEW_BYTES = 8192
# What a note says about a return series, in order of priority.
SERIES_TAGS = (
    ("pro_forma", r"pro forma|pro-forma|proforma"),
    ("blended", r"blended|blend"),
    ("backfilled", r"backfilled|backfill|back-filled"),
    ("gross_net_ambiguous", r"gross vs net|gross/net|gross-vs-net|gross net"),
    ("currency_noted", r"currency|usd|eur|fx"),
    ("composite", r"composite"),
)
SENSITIVE_KEYS = ("document_text", "full_text", "raw_document", "raw_text", "source_text")
MARKED = r"(?i)\b(?:PROPRIETARY|CONFIDENTIAL)[:\-_ ][A-Za-z0-9_.:/-]+"
REDACTED = "[REDACTED]"


def injection_code(text: Column) -> Column:
    return F.coalesce(*[F.when(F.rlike(text, F.lit(p)), code) for code, p in INJECTION])


def series_tag(note: Column, has_gaps: Column) -> Column:
    """The tag of highest priority in a note, or backfilled for a series with gaps, else standard."""
    hit = lambda p: F.coalesce(F.rlike(note, F.lit(rf"(?i)\b(?:{p})\b")), F.lit(False))
    return F.coalesce(*[F.when(hit(p) | has_gaps if tag == "backfilled" else hit(p), tag) for tag, p in SERIES_TAGS], F.lit("standard"))


def preview(content: Column) -> Column:
    """The text of the first PREVIEW_BYTES bytes of an artifact; a character cut in two and invalid bytes are left out."""
    return F.replace(F.make_valid_utf8(F.substring(content, 1, PREVIEW_BYTES).cast("string")), F.lit("\ufffd"), F.lit(""))


def visual_label(text: Column, byte_size: Column, source_ref: Column) -> dict[str, Column]:
    """Label, confidence and reasons of an artifact, from its preview text, size and source reference."""
    found = visual_facts(text, byte_size, source_ref)
    return {k: found[k] for k in ("label", "confidence", "reasons")}


def visual_facts(text: Column, byte_size: Column, source_ref: Column) -> Column:
    """visual_label as one struct, for which a text is read once."""
    low = F.lower(text)
    hits = lambda x, terms: reduce(lambda a, b: a + b, [F.contains(x, F.lit(t)).cast("int") for t in terms])
    terms = F.element_at(F.transform(F.array(low), lambda x: F.struct(hits(x, INFORMATIVE).alias("good"), hits(x, BOILERPLATE).alias("bad"))), 1)
    at_least = lambda n: F.rlike(text, F.lit(TOKENS % n))
    logo = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(source_ref, F.lit(""))), F.lit(m)) for m in LOGO_MARKERS])
    facts = F.struct(terms.alias("terms"), at_least(18).alias("dense"), at_least(6).alias("some"), F.rlike(text, F.lit(CHART)).alias("chart"), logo.alias("logo"), byte_size.alias("bytes"))
    scored = F.transform(F.array(facts), _scored)
    return F.element_at(F.transform(scored, _labelled), 1)


def _scored(x: Column) -> Column:
    good, bad, dense = x["terms"]["good"], x["terms"]["bad"], x["dense"]
    sparse = ~x["some"] | (~dense & (x["bytes"] <= 512))
    for_score = F.least(good, F.lit(4)) * 2 + F.when(x["chart"], 3).otherwise(0) + F.when(dense, 2).otherwise(0)
    against = F.least(bad, F.lit(4)) * 2 + F.when(~dense & sparse, 2).otherwise(0) + F.when(x["logo"], 3).otherwise(0)
    reasons = F.array_compact(
        F.array(F.when(good > 0, "informative_terms"), F.when(bad > 0, "boilerplate_terms"), F.when(x["chart"], "chart_indicators"), F.when(dense, "text_density_high"), F.when(~dense & sparse, "text_density_low"), F.when(x["logo"], "logo_banner_pattern"))
    )
    return F.struct(for_score.alias("for"), against.alias("against"), reasons.alias("reasons"))


def _labelled(x: Column) -> Column:
    for_score, against, reasons = x["for"], x["against"], x["reasons"]
    informative = for_score >= against
    base = F.when(informative, 0.62).otherwise(0.58)
    confidence = F.round(F.least(F.lit(0.95), base + F.least(F.lit(0.25), F.abs(for_score - against) * 0.04) + F.least(F.lit(0.12), (for_score + against) * 0.01)), 2)
    return F.struct(
        F.when(informative, "informative").otherwise("boilerplate").alias("label"),
        confidence.alias("confidence"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).otherwise("fallback_content_heuristic").alias("reasons"),
    )


def redact_text(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, REDACTED)


def redact_payload(payload: Column) -> Column:
    """A map<string,string> without keys that begin with _, sensitive values masked, marked tokens replaced."""
    kept = F.map_filter(payload, lambda k, _: ~F.startswith(k, F.lit("_")))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(F.trim(k)).isin(*SENSITIVE_KEYS), REDACTED).otherwise(redact_text(v)))


def table_rows(docs: DataFrame) -> DataFrame:
    """(document_id, line, cells) of the lines of a text that are Markdown table rows, rules left out."""
    lines = docs.select("document_id", F.posexplode(F.split("content", "\n")).alias("line", "raw"))
    rows = lines.where(F.rlike(F.trim("raw"), F.lit(r"^\|.*\|$")) & ~F.rlike("raw", F.lit(r"^[\s|:-]+$")))
    inner = F.regexp_replace(F.trim("raw"), r"^\||\|$", "")
    return rows.select("document_id", "line", F.transform(F.split(inner, r"\|"), lambda x: F.trim(x)).alias("cells"))
