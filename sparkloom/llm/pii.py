"""Personal data by weak supervision, in SQL functions only.

Patterns propose spans. Labelers then vote yes, no or nothing on each: patterns (does the value
pass its format's checks), gazetteers (known prefixes and endings), and contexts (words just
before it that speak for or against). Expectation-maximisation on the counts of vote patterns
estimates how reliable every labeler is and how likely each pattern is true; with these
likelihoods as targets a logistic classifier over votes and shape is trained, and its score
decides. Only counts of patterns, of which there is a fixed number, reach the driver. Spans of
the base patterns always stay.
"""

from __future__ import annotations

from collections import defaultdict
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stash

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
LEAST_SCORE = 1.5  # of the classifier, a logit
LABELERS = ("format", "gazetteer", "context", "counter", "edges")

# The patterns. Those of the base kinds find what the plain ones do, in linear time:
# a run of the first class is tried once, and at the end of a match, and is never given back.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_loose": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "phone_loose": r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9.-]?[0-9A-Za-z])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,4})?+(?![A-Za-z0-9])",
}
_GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "email_loose": lambda t: F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at}")),
    "phone_loose": lambda t: F.rlike(t, F.lit(r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}")),
    "ssn": lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    "iban": lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
}
# Gazetteers and context words.
ENDINGS = r"\.(?:com|net|org|edu|gov|io|de|fr|es|uk|us|info|co)$"
DIALLING = r"^\+?(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|36|38)"
COUNTRIES = r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PL|PT|IE|SE|DK|FI|NO|LU)"
FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|reach|correo|courriel)\W{1,6}(?:\w{1,12}\W{1,3}){0,2}$",
    "ip": r"(?i)(?:ip|host|server|address|from|client|login)\W{1,6}(?:\w{1,12}\W{1,3}){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|pan|karte|carte|tarjeta)\W{1,6}(?:\w{1,12}\W{1,3}){0,2}$",
    "phone": r"(?i)(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|contact|telefon|appel)\W{1,6}(?:\w{1,12}\W{1,3}){0,2}$",
    "ssn": r"(?i)(?:ssn|social|security|insurance)\W{1,6}(?:\w{1,12}\W{1,3}){0,2}$",
    "iban": r"(?i)(?:iban|account|bank|konto|compte|cuenta)\W{1,6}(?:\w{1,12}\W{1,3}){0,2}$",
}
AGAINST = r"(?i)(?:version|release|order|isbn|issn|sku|part|serial|build|ticket|invoice|ref|id|no|nr|v)\W{0,3}$"


MATCH = "struct<pattern:string,kind:string,i:int,gap:int,value:string,before:string,after:string>"


def _matches(text: Column, name: str) -> Column:
    """The matches of a pattern with the gap before each and what stands around it; the text is cut once, as an array of one that the spans are taken from."""
    pattern = PATTERNS[name]
    kind = name.split("_")[0]
    bound = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("pieces")))
    none = F.array().cast(f"array<{MATCH}>")

    def spans(whole: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            piece, rest = F.get(whole["pieces"], i), F.get(whole["pieces"], i + 1)
            return F.struct(
                F.lit(name).alias("pattern"),
                F.lit(kind).alias("kind"),
                i.cast("int").alias("i"),
                F.length(piece).alias("gap"),
                m.alias("value"),
                F.right(piece, F.lit(40)).alias("before"),
                F.left(rest, F.lit(2)).alias("after"),
            )

        return F.transform(whole["found"], span)

    return F.when(_GATES[name](text), F.get(F.transform(bound, spans), F.lit(0))).otherwise(none)


def _passes(kind: Column, value: Column) -> Column:
    """Whether a value passes the checks of its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(parts, lambda x: (F.length(x) <= 3) & (F.when(F.length(x) <= 3, F.try_to_number(x, F.lit("999")).cast("int")) <= 255)))
        .when(kind == "card", F.length(digits).between(13, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .when(kind == "ssn", ~F.rlike(value, F.lit("^(?:000|666|9)|-00-|-0000$")))
        .when(kind == "iban", F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34))
        .otherwise(False)
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Every proposed span of docs(doc_id, text), and one row without a span for each document.

    (row_id, doc_id, pattern, kind, start, end, base, votes by labeler, shape); positions count
    code points.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("row_id", "doc_id", F.explode(F.concat(*[_matches(F.col("text"), name) for name in PATTERNS], F.array(F.lit(None).cast(MATCH)))).alias("m")).select("row_id", "doc_id", "m.*")
    w = Window.partitionBy("row_id", "pattern").orderBy("i")
    long_ = F.length("value")
    found = found.withColumn("start", F.sum(F.col("gap") + long_).over(w) - long_).withColumn("end", F.col("start") + long_)
    kind, value, before, after = F.col("kind"), F.col("value"), F.col("before"), F.col("after")
    passes = _passes(kind, value)
    plain = F.col("pattern").isin(*BASE_KINDS)
    base = plain & passes
    # a card pattern also finds every short number; only those with about as many digits are candidates
    near = F.when(F.col("pattern") == "card", F.length(F.regexp_replace(value, "[^0-9]", "")).between(13, 19)).otherwise(True)
    found = found.withColumn("base", F.coalesce(base, F.lit(False))).where(F.col("kind").isNull() | F.col("base") | near)

    known = F.when(kind == "email", F.rlike(F.lower(value), F.lit(ENDINGS))).when(kind == "phone", F.rlike(value, F.lit(DIALLING))).when(kind == "card", F.rlike(value, F.lit(ISSUERS))).when(kind == "iban", F.rlike(value, F.lit(COUNTRIES)))
    speaks = F.lit(False)
    for k in KINDS:
        speaks = F.when(kind == k, F.rlike(before, F.lit(FOR[k]))).otherwise(speaks)
    edge = F.rlike(before, F.lit(r"(?:^|[\s(\[<\"':;,])$")) & F.rlike(after, F.lit(r"^(?:$|[\s)\]>\"':;,.!?])"))
    vote = {
        "format": F.when(passes, 1).otherwise(-1),
        "gazetteer": F.when(known, 1).when(~known, -1).otherwise(0),
        "context": F.when(speaks, 1).otherwise(0),
        "counter": F.when(F.rlike(before, F.lit(AGAINST)), -1).otherwise(0),
        "edges": F.when(edge, 1).otherwise(-1),
    }
    shape = F.concat_ws("|", "pattern", F.least(F.floor(F.log2(F.greatest(long_, F.lit(1)))), F.lit(6)))
    return found.select("row_id", "doc_id", "pattern", "kind", "start", "end", "base", *[vote[v].alias(v) for v in LABELERS], shape.alias("shape"))


def _settled(taken: DataFrame) -> DataFrame:
    """taken without the added spans that overlap one of the base, or one that begins earlier."""
    w = Window.partitionBy("row_id").orderBy("start", F.desc("base"), "pattern", "end")
    back = Window.partitionBy("row_id").orderBy(F.desc("start"), "base", F.desc("pattern"), F.desc("end"))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    hit = (F.coalesce(F.max(base_end).over(before), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(base_start).over(after), F.col("end")) < F.col("end"))
    free = taken.withColumn("hit", hit).where(F.col("kind").isNull() | F.col("base") | ~F.col("hit"))
    again = F.coalesce(F.max(F.when(~F.col("base"), F.col("end"))).over(before), F.lit(-1)) > F.col("start")
    return free.withColumn("hit", again).where(F.col("kind").isNull() | F.col("base") | ~F.col("hit")).drop("hit")


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count).

    Returns the share of true spans by kind and, by (labeler, truth), the probability of each vote.
    Votes are taken as independent given the truth; a prior of agreement with the truth sets which class is which.
    """
    kinds = {k for k, _, _ in patterns}
    share = dict.fromkeys(kinds, 0.6)
    table = {(j, y): {v: 0.6 if v == (1 if y else -1) else 0.2 for v in (-1, 0, 1)} for j in range(len(LABELERS)) for y in (0, 1)}
    for _ in range(rounds):
        mass: dict = defaultdict(float)
        votes: dict = defaultdict(float)
        for kind, seen, n in patterns:
            p = posterior(kind, seen, share, table)
            for y, q in ((1, p), (0, 1 - p)):
                mass[kind, y] += n * q
                for j, v in enumerate(seen):
                    votes[j, y, v] += n * q
        share = {k: (mass[k, 1] + 3) / (mass[k, 0] + mass[k, 1] + 5) for k in kinds}
        for j, y in table:
            prior = {v: 6.0 if v == (1 if y else -1) else 2.0 for v in (-1, 0, 1)}
            total = sum(votes[j, y, v] + prior[v] for v in (-1, 0, 1))
            table[j, y] = {v: (votes[j, y, v] + prior[v]) / total for v in (-1, 0, 1)}
    return share, table


def posterior(kind: str, seen: tuple[int, ...], share: dict, table: dict) -> float:
    odds = log(share[kind] / (1 - share[kind])) + sum(log(table[j, 1][v] / table[j, 0][v]) for j, v in enumerate(seen))
    return 1 / (1 + exp(-max(-30.0, min(30.0, odds))))


def train(cells: list[tuple[str, str, tuple[int, ...], int]], rounds: int = 60) -> dict[str, float]:
    """Weights of a logistic classifier from (kind, shape, votes, count), with EM likelihoods as targets."""
    sums: dict = defaultdict(int)
    for kind, _, seen, n in cells:
        sums[kind, seen] += n
    share, table = reliabilities([(k, v, n) for (k, v), n in sorted(sums.items())])
    data = [(_features(kind, shape, seen), posterior(kind, seen, share, table), n) for kind, shape, seen, n in cells]
    whole = sum(n for _, _, n in data) or 1
    weights: dict[str, float] = defaultdict(float)
    for _ in range(rounds):
        step: dict[str, float] = defaultdict(float)
        for names, target, n in data:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, sum(weights[f] for f in names)))))
            for f in names:
                step[f] += n * (target - p)
        for f, g in step.items():
            weights[f] += 2.0 * (g / whole - 1e-4 * weights[f])
    return dict(weights)


def _features(kind: str, shape: str, seen: tuple[int, ...]) -> list[str]:
    return ["bias", f"kind={kind}", f"shape={shape}", *[f"{name}={v}" for name, v in zip(LABELERS, seen, strict=True)]]


def _score(weights: dict[str, float]) -> Column:
    """The classifier's logit as an expression."""
    table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else F.create_map(F.lit("bias"), F.lit(0.0))
    total = F.lit(weights.get("bias", 0.0))
    for name in (F.concat(F.lit("kind="), "kind"), F.concat(F.lit("shape="), "shape"), *[F.concat(F.lit(f"{v}="), F.col(v).cast("string")) for v in LABELERS]):
        total = total + F.coalesce(F.try_element_at(table, name), F.lit(0.0))
    return total


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_added for every row of docs(doc_id, text).

    Counts and base_spans are of the base patterns; spans has the accepted ones too, but for those
    that overlap a base span or an accepted one that begins earlier, all as kind:start:end by kind
    and start. The whole text is read; null is empty and has no spans. Rows
    that repeat get a row each; other columns are ignored; an empty table gives no rows.
    """
    spans = stash(candidates(docs), "candidates")
    cells = spans.where("kind is not null").groupBy("kind", "shape", *LABELERS).count().collect()  # a fixed number of votes and shapes
    weights = train(sorted((r["kind"], r["shape"], tuple(r[v] for v in LABELERS), r["count"]) for r in cells))
    taken = _settled(spans.withColumn("taken", F.col("base") | (_score(weights) > LEAST_SCORE)).where("kind is null or taken"))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct(place.alias("place"), "start", "end", "kind")
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    each = taken.groupBy("row_id", "doc_id").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE_KINDS],
        F.collect_list(F.when(F.col("base"), item)).alias("base_list"),
        F.collect_list(F.when(F.col("taken"), item)).alias("all_list"),
    )
    return each.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], text(F.col("base_list")).alias("base_spans"), text(F.col("all_list")).alias("spans"), (F.size("all_list") - F.size("base_list")).alias("n_added"))
