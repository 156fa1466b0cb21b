"""Homomorphic multiset hash of paragraphs.

Every paragraph (line) is hashed to a wide vector, and a text's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo a power of two. The order of the paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts. Eight lanes modulo 2**32 hold a uniform hash of the paragraph: they
decide equality. 180 lanes modulo 2**32, packed in twos, hold a bit each for every sentence of the
paragraph: with ones counted, a lane is (count of ones) - (count of zeros) =
2 * ones - sentences, a sum of random signs. The mean product of two texts' lanes estimates how
many sentences they share, which gives a likeness without the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import HOT, LEAST_HOT

WIDE = 8
HASHES, SHIFTS, FIELDS = 3, 30, 2  # three hashes, of which 30 shifts give two bits each
LANES = HASHES * SHIFTS * FIELDS
FIELD_BITS = 32
MODULUS = 1 << FIELD_BITS
MASK = sum(1 << (FIELD_BITS * k) for k in range(FIELDS))
SENTENCE = r"[.!?]+(?:[^\S\n]+|(?=\n)|\z)|\n"  # never across paragraphs
GROUP_ROWS = 1000
MOST_PARTS = 50_000


def _units(text: Column, which: int) -> Column:
    """The paragraphs and sentences of a text, and one empty row that keeps texts without any."""
    paragraphs = F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.struct(F.lit(which).alias("which"), x.alias("paragraph"), F.lit(None).cast("string").alias("sentence")))
    sentences = F.transform(F.filter(F.split(text, SENTENCE), lambda x: x != ""), lambda x: F.struct(F.lit(which).alias("which"), F.lit(None).cast("string").alias("paragraph"), x.alias("sentence")))
    none = F.array(F.struct(F.lit(which).alias("which"), F.lit(None).cast("string").alias("paragraph"), F.lit(None).cast("string").alias("sentence")))
    return F.concat(paragraphs, sentences, none)


def _lane_sums(units: DataFrame, keys: list[str]) -> DataFrame:
    """wide, signs (packed) and counts, summed over the units of each key: fewer than 2**31, as those of one text always are."""
    hashed = units.select(
        *keys,
        F.when(F.col("u.paragraph").isNotNull(), 1).otherwise(0).alias("is_paragraph"),
        F.when(F.col("u.sentence").isNotNull(), 1).otherwise(0).alias("is_sentence"),
        *[F.when(F.col("u.paragraph").isNotNull(), F.xxhash64("u.paragraph", F.lit(k)).bitwiseAND(F.lit((1 << 32) - 1))).otherwise(0).alias(f"w{k}") for k in range(WIDE)],
        *[F.when(F.col("u.sentence").isNotNull(), F.xxhash64("u.sentence", F.lit(100 + k))).otherwise(0).alias(f"h{k}") for k in range(HASHES)],
    )
    sums = hashed.groupBy(*keys).agg(
        F.sum("is_paragraph").alias("n_paragraphs"),
        F.sum("is_sentence").alias("n_sentences"),
        *[F.sum(f"w{k}").alias(f"w{k}") for k in range(WIDE)],
        *[F.sum(F.shiftrightunsigned(f"h{k}", s).bitwiseAND(F.lit(MASK))).alias(f"s{k}_{s}") for k in range(HASHES) for s in range(SHIFTS)],
    )
    return sums.select(
        *keys,
        "n_paragraphs",
        "n_sentences",
        F.array(*[F.pmod(f"w{k}", F.lit(MODULUS)) for k in range(WIDE)]).alias("wide"),
        F.array(*[f"s{k}_{s}" for k in range(HASHES) for s in range(SHIFTS)]).alias("signs"),
    )


def _print_of(wide: Column, signs: Column, n: Column) -> Column:
    """The fingerprint as text: the wide lanes, the sentences and the packed sign lanes, in hexadecimal."""
    lanes = F.array_join(F.transform(wide, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    packed = F.array_join(F.transform(signs, lambda x: F.lower(F.hex(x))), ".")
    return F.concat_ws("-", lanes, F.lower(F.hex(n)), packed)


def _field(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, FIELD_BITS * k).bitwiseAND(F.lit(MODULUS - 1))


def _packed(*fields: Column) -> Column:
    """Fields, each modulo 2**32, as one bigint."""
    low, high = (F.pmod(x, F.lit(MODULUS)) for x in fields)
    return low.bitwiseOR(F.shiftleft(high, FIELD_BITS))


def likeness(wide_a: Column, signs_a: Column, n_a: Column, wide_b: Column, signs_b: Column, n_b: Column) -> Column:
    """Estimated likeness of two texts' sentences, 2 <a, b> / (<a, a> + <b, b>) with a and b their counts by sentence, from 0 to 1.

    Where no text repeats a sentence this is their common share, 2 * both / (n_a + n_b). It is 1 if
    the wide lanes are equal. A lane is read as the number nearest zero that it can stand for, which
    is the sum of signs itself for texts of any length that Spark can hold.
    """

    def signed(ones: Column, n: Column) -> Column:
        return F.pmod(2 * ones - n + (MODULUS >> 1), F.lit(MODULUS)) - (MODULUS >> 1)

    def add(total: Column, lanes: Column) -> Column:
        pairs = [(signed(_field(lanes["x"], k), n_a), signed(_field(lanes["y"], k), n_b)) for k in range(FIELDS)]
        pairs = [(x.cast("double"), y.cast("double")) for x, y in pairs]
        return F.struct((total["both"] + sum((x * y for x, y in pairs), F.lit(0.0))).alias("both"), (total["own"] + sum((x * x + y * y for x, y in pairs), F.lit(0.0))).alias("own"))

    lanes = F.zip_with(signs_a, signs_b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    sums = F.aggregate(lanes, F.struct(F.lit(0.0).alias("both"), F.lit(0.0).alias("own")), add, lambda t: F.coalesce(F.try_divide(2 * t["both"], t["own"]), F.lit(0.0)))
    return F.when(wide_a == wide_b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sums)))


def lanes(docs: DataFrame) -> DataFrame:
    """doc_id, lanes, n_paragraphs for every distinct doc_id of docs(doc_id, text): the fingerprint as struct(wide, signs, n), to add and subtract.

    Each text is summed, and brought below the moduli, before the texts of an id are, so an id may
    have any number of them, and they meet as one row a map task.
    """
    units = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.explode(_units(F.coalesce("text", F.lit("")), 0)).alias("u"))
    rows = _lane_sums(units, ["row_id", "doc_id"])
    wide, packed = range(WIDE), range(HASHES * SHIFTS)
    sums = rows.groupBy("doc_id").agg(
        F.sum("n_paragraphs").alias("n_paragraphs"),
        F.sum("n_sentences").alias("n"),
        *[F.sum(F.get("wide", F.lit(k))).alias(f"w{k}") for k in wide],
        *[F.sum(_field(F.get("signs", F.lit(k)), f)).alias(f"s{k}_{f}") for k in packed for f in range(FIELDS)],
    )
    signs = F.array(*[_packed(*[F.col(f"s{k}_{f}") for f in range(FIELDS)]) for k in packed])
    return sums.select("doc_id", F.struct(F.array(*[F.pmod(f"w{k}", F.lit(MODULUS)) for k in wide]).alias("wide"), signs.alias("signs"), "n").alias("lanes"), "n_paragraphs")


def inserted(lanes: Column, paragraphs: Column) -> Column:
    """The lanes of a text after paragraphs, given by their lanes, were inserted anywhere."""
    return _combined(lanes, paragraphs, 1)


def deleted(lanes: Column, paragraphs: Column) -> Column:
    """The lanes of a text after paragraphs that it holds, given by their lanes, were deleted."""
    return _combined(lanes, paragraphs, -1)


def _combined(a: Column, b: Column, sign: int) -> Column:
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))
    signs = F.zip_with(a["signs"], b["signs"], lambda x, y: _packed(*[_field(x, k) + sign * _field(y, k) for k in range(FIELDS)]))
    return F.struct(wide.alias("wide"), signs.alias("signs"), (a["n"] + sign * b["n"]).alias("n"))


def print_of(lanes: Column) -> Column:
    """The fingerprint of lanes as text."""
    return _print_of(lanes["wide"], lanes["signs"], lanes["n"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_paragraphs for every distinct doc_id of docs(doc_id, text); null is empty; texts of one id are summed."""
    return lanes(docs).select("doc_id", print_of(F.col("lanes")).alias("fingerprint"), "n_paragraphs")


def _place(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most x, by halving; -1 for null."""
    if not cuts:
        return F.when(x.isNull(), -1).otherwise(0)
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.element_at(held, F.least(at + step, F.lit(len(cuts)))) <= x), at + step).otherwise(at))
    return F.when(x.isNull(), -1).otherwise(found)


def _parts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts(doc_id, text, h) with part, ranges in order of (doc_id, h) of about GROUP_ROWS rows; and (part, doc_id, h, guest_part) of the first row of each.

    The ranges are quantiles of the ids, MOST_PARTS at most. An id of very many rows, null too, is a
    range of its own and cut again by h, a uniform hash. guest_part is the part before (before the
    first comes the last). The driver sees the cuts and one row for each part.
    """
    n = texts.count()
    share = max(LEAST_HOT, n // HOT)
    hot = {r["doc_id"]: -(-r["count"] // share) for r in texts.groupBy("doc_id").count().where(F.col("count") > share).collect()}  # HOT rows at most
    k = min(MOST_PARTS, -(-n // GROUP_ROWS))
    cuts = texts.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k)).head()[0] if k > 1 else None
    ids = [x for x in hot if x is not None]
    cuts = sorted({*(cuts or []), *ids, *(x + 1 for x in ids if x < 2**63 - 1)})
    cells = F.lit(1)
    if hot:
        numbers = texts.sparkSession.createDataFrame(list(hot.items()), "id bigint, cells int")
        texts = texts.join(F.broadcast(numbers), texts["doc_id"].eqNullSafe(numbers["id"]), "left").drop("id")
        cells = F.coalesce("cells", F.lit(1))
    cell = F.least(F.floor((F.col("h") / float(2**64) + 0.5) * cells), cells - 1)
    texts = texts.withColumn("part", (_place(F.col("doc_id"), cuts) + 1).cast("bigint") * (2 * HOT) + cell).select("doc_id", "text", "h", "part")
    firsts = sorted(texts.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("part", "x.*").collect())
    guests = [(*row, firsts[i - 1]["part"]) for i, row in enumerate(firsts)]
    return texts, texts.sparkSession.createDataFrame(guests, "part bigint, doc_id bigint, h bigint, guest_part bigint")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every row of docs(doc_id, text), of its edited text, and how alike they and the next row's are.

    Edited: the last floor(n_chars / 2) characters give way to the first as many of the next row's
    text, by doc_id (null first) and then a hash of the text; after the last comes the first. null
    is empty. A single row is its own next row. Rows that repeat are rows of their own; texts of any
    length are read whole; other columns are ignored; an empty table gives no rows.

    The texts are shuffled once, by ranges of ids; the first row of each range also goes, as a
    guest, to the range before it, so that every row finds its next row in its own task. Rows of one
    id are dealt to several tasks; only such as are equal in id and text stay together.
    """
    text = F.coalesce("text", F.lit(""))
    texts, firsts = _parts(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")))
    seats = F.array_compact(F.array(F.struct(texts["part"], F.lit(0).alias("guest")), F.when(F.col("guest_part").isNotNull(), F.struct(F.col("guest_part").alias("part"), F.lit(1).alias("guest")))))
    first = (texts["part"] == firsts["part"]) & texts["doc_id"].eqNullSafe(firsts["doc_id"]) & (texts["h"] == firsts["h"])
    seated = texts.join(F.broadcast(firsts), first, "left").select(texts["doc_id"], "text", texts["h"], F.explode(seats).alias("seat"))
    seated = seated.select("seat.part", "seat.guest", "doc_id", "text", "h")
    w = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "h")
    seated = seated.withColumns({"seq": F.row_number().over(w), "next": F.lead("text").over(w)})

    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    rows = seated.select("part", "seq", "guest", "doc_id", "text", n.cast("bigint").alias("n_chars"), F.when(F.col("guest") == 0, edited).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))  # below the generator, so once a row and not once a unit
    units = F.when(F.col("guest") == 0, F.concat(_units(F.col("text"), 0), _units(F.col("edited"), 1))).otherwise(_units(F.col("text"), 0))
    keys = ["part", "seq", "guest", "doc_id", "n_chars", "edited_sha256"]
    units = rows.select(*keys, F.explode(units).alias("u"))
    sums = _lane_sums(units.select(*keys, F.col("u.which").alias("which"), "u"), [*keys, "which"])

    # by (seq, which) a row's text, its edited text and the next row's text follow each other
    w = Window.partitionBy("part").orderBy("seq", "which")
    mine = F.struct("wide", "signs", F.col("n_sentences").alias("n"))
    placed = sums.select(*keys, "which", mine.alias("a"), F.lead(mine, 1).over(w).alias("b"), F.lead(mine, 2).over(w).alias("c")).where("guest = 0 and which = 0")

    def near(other: str) -> Column:
        return likeness(F.col("a.wide"), F.col("a.signs"), F.col("a.n"), F.col(f"{other}.wide"), F.col(f"{other}.signs"), F.col(f"{other}.n"))

    return placed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _print_of(F.col("a.wide"), F.col("a.signs"), F.col("a.n")).alias("fingerprint"),
        _print_of(F.col("b.wide"), F.col("b.signs"), F.col("b.n")).alias("edited_fingerprint"),
        near("b").alias("near_edited"),
        near("c").alias("near_next"),
    )
