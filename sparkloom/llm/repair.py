"""Conversation structure repair by a dynamic program whose layers are shared in a prefix trie.

A conversation's rows, by turn, become a signature: one symbol a row for its role and fault. What
edits cost depends on the signature alone, so each distinct one is solved once:

1. ``_segments`` streams the rows of each conversation and cuts its signature every SEGMENT rows.
2. The distinct signatures are sorted over the cluster. A task walks its sorted share as a prefix
   trie: it keeps the layers of the current path only, goes back to what a signature shares with
   the one before it, and extends from there. A layer holds, for each state of the role grammar
   ``(s?(ua)+)?``, the least cost and the ASCII-least edits of that cost.
3. Answers are joined back to the segments, the frequent signatures split over tasks. A longer
   conversation's segments are solved from every state, and the streaming pass that writes the
   repaired rows puts them together.

A conversation of any length is streamed: a task holds its edits (a letter a row), not its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import crc_mod, hot_keys, split_join, stash

#: Rows in a segment; a conversation of more is put together from several.
SEGMENT = 4096

#: What counts as white space at the end of a text.
WHITE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States of the role grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What still has to be inserted at the end.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = "conv_id bigint, position bigint, edit string, role string, text string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it with the same turn, 4
    makes its role user. Nulls count as one space, in role and text for good. Equal rows fare alike.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), crc_mod(key, 20).alias("h")).where("h <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _read(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and same: equal for equal role and text."""
    clean = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    return clean.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _fault(text: Column) -> Column:
    """2 for a blank text, 1 for one that does not end in a full stop, 0 else."""
    body = F.rtrim(text, F.lit(WHITE))
    return F.when(body == "", 2).when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)


def _marked(rows: DataFrame) -> DataFrame:
    """Narrow rows: conv_id, turn, same, initial, fault, and early: role and text do not occur in an earlier turn."""
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.hex("same")), 256)
    narrow = rows.select("conv_id", "turn", "same", F.substring("role", 1, 1).alias("initial"), _fault(F.col("text")).alias("fault"), key.alias("key"))
    firsts = stash(narrow.groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats")
    marked = split_join(narrow, firsts.select("key", "first"), "key", "left", hot=hot_keys(narrow, "key", firsts.select("key", "n")))
    return marked.select("conv_id", "turn", "same", "initial", "fault", (F.col("first").isNull() | F.col("turn").eqNullSafe(F.col("first.turn"))).alias("early"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by conversation, turn and same: signatures, the counts of a conversation in its last."""
    out: list[tuple] = []
    conv, open_, symbols, seg, last = None, False, [], 0, None
    gaps = counts = None

    def close(final: bool) -> None:
        whole = [*counts, gaps[1] - gaps[0] + 1 - gaps[2] if gaps else 0] if final else [None] * 5
        out.append((conv, seg, "".join(symbols), final and seg == 0, *whole))

    for batch in batches:
        for c, turn, same, initial, fault, early in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not open_ or c != conv:
                if open_:
                    close(True)
                conv, open_, symbols, seg, last, gaps, counts = c, True, [], 0, None, None, [0, 0, 0, 0]
            if len(symbols) == SEGMENT:
                close(False)
                symbols, seg = [], seg + 1
            kind = 0 if fault == 2 else 1 if not early or last and last[:2] == (turn, same) else 2 if fault else None
            if kind is not None:
                counts[kind] += 1
            if last and last[2] + initial not in ("su", "ua", "au"):
                counts[3] += 1
            if turn is not None:
                gaps = (turn, turn, 1) if gaps is None else (gaps[0], turn, gaps[2] + (turn != gaps[1]))
            symbol = initial if initial in ("s", "u", "a") else "x"
            symbols.append("d" if kind in (0, 1) else symbol.upper() if kind == 2 else symbol)
            last = (turn, same, initial)
        yield _batch(out, _SEGMENTS)
        out.clear()
    if open_:
        close(True)
        yield _batch(out, _SEGMENTS)


_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("seg", pa.int64()), ("signature", pa.string()), ("single", pa.bool_())]
    + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "gaps")]
)
_ANSWERS = pa.schema([("signature", pa.string()), ("single", pa.bool_()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _moves() -> dict[str, list[tuple[int, int, int, str]]]:
    """For each symbol, the best (state, next state, cost, edits) that end with the row itself."""
    found = {}
    for symbol in "suaxSUAXd":
        best: dict[tuple[int, int], tuple[int, str]] = {}
        extra, role = TRUNCATED if symbol.isupper() else 0, symbol.lower()
        for state in STATES:
            at = state
            for inserts in range(4):
                ways = [(at, DELETE, "D")]
                if symbol != "d":
                    ways.append((NEXT[at], REROLE + extra, "R"))
                    if role == "s" and at == START:
                        ways.append((SYSTEM, KEEP + extra, "K"))
                    if role == {USER: "u", ASSISTANT: "a"}[NEXT[at]]:
                        ways.append((NEXT[at], KEEP + extra, "K"))
                for to, cost, edit in ways:
                    way = (INSERT * inserts + cost, "I" * inserts + edit)
                    best[state, to] = min(best.get((state, to), way), way)
                at = NEXT[at]
        found[symbol] = [(s, t, *way) for (s, t), way in best.items()]
    return found


MOVES = _moves()
#: state -> (cost, rank of the edits among those of the layer, state before, edits since)
Layer = dict[int, tuple[int, int, int, str]]


def _extended(layer: Layer, moves: list[tuple[int, int, int, str]]) -> Layer:
    """The layer one row on. Edits that end with a row are no prefix of each other, so ranks settle ties."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for state, to, cost, edits in moves:
        if (at := layer.get(state)) is not None:
            way = (at[0] + cost, at[1], edits, state)
            if to not in best or way < best[to]:
                best[to] = way
    order = {to: k for k, to in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
    return {to: (cost, order[to], state, edits) for to, (cost, _, edits, state) in best.items()}


def _edits(path: list[Layer], state: int) -> str:
    found = []
    for layer in reversed(path[1:]):
        _, _, before, edits = layer[state]
        found.append(edits)
        state = before
    return "".join(reversed(found))


def _finish(layer: Layer) -> tuple[int, int]:
    """(cost, state) of the best end."""
    return min((at[0] + INSERT * len(TAIL[s]), at[1], s) for s, at in layer.items())[::2]


class TrieWalk:
    """Solves signatures given in sorted order; ``layers`` counts those it had to compute."""

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.starts, self.before, self.layers = starts, "", 0
        self.paths: list[list[Layer]] = [[{s: (0, 0, s, "")}] for s in starts]

    def extend(self, signature: str) -> None:
        shared = next((k for k, (x, y) in enumerate(zip(signature, self.before, strict=False)) if x != y), min(len(signature), len(self.before)))
        for path in self.paths:
            del path[shared + 1 :]
            for symbol in signature[shared:]:
                path.append(_extended(path[-1], MOVES[symbol]))
        self.layers += len(signature) - shared
        self.before = signature

    def whole(self) -> tuple[list[int], list[str]]:
        cost, state = _finish(self.paths[0][-1])
        return [cost], [_edits(self.paths[0], state) + TAIL[state]]

    def matrix(self) -> tuple[list[int | None], list[str | None]]:
        """From each state to each."""
        ends = [(path, t, path[-1].get(t)) for path in self.paths for t in STATES]
        return [at and at[0] for _, _, at in ends], [at and _edits(path, t) for path, t, at in ends]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walks = {True: TrieWalk((START,)), False: TrieWalk(STATES)}
    for batch in batches:
        out = []
        for single, signature in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            walk = walks[single]
            walk.extend(signature)
            out.append((signature, single, *(walk.whole() if single else walk.matrix())))
        yield _batch(out, _ANSWERS)


def _joined(parts: list[tuple[list[int | None], list[str | None]]]) -> tuple[int, str]:
    """Cost and edits of a conversation from its segments."""
    if len(parts) == 1 and len(parts[0][0]) == 1:
        return parts[0][0][0], parts[0][1][0]
    path: list[Layer] = [{START: (0, 0, START, "")}]
    for costs, edits in parts:
        moves = [(s, t, costs[4 * s + t], edits[4 * s + t]) for s in STATES for t in STATES if costs[4 * s + t] is not None]
        path.append(_extended(path[-1], moves))
    cost, state = _finish(path[-1])
    return cost, _edits(path, state) + TAIL[state]


def _conversations(batches: Iterator[pa.RecordBatch], each: Iterator) -> Iterator[tuple]:
    """Yield ("row", conv_id, position, edit, role, text) for what is kept or put in, and ("end", conv_id, counts, cost, audit)."""
    conv, open_, parts, totals, cost, audit, at, state, position = None, False, [], None, 0, None, 0, START, 0

    def insert() -> Iterator[tuple]:
        nonlocal at, state, position
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            yield "row", conv, position, "I", ROLE[state], ""
            at, position = at + 1, position + 1

    for batch in batches:
        for c, kind, role, text, costs, edits, *counts in zip(*(batch.column(n).to_pylist() for n in each), strict=True):
            if not open_ or c != conv:
                if open_:
                    yield "end", conv, totals, cost, audit or ""
                conv, open_, parts, totals, cost, audit, at, state, position = c, True, [], None, 0, None, 0, START, 0
            if kind == 0:
                parts.append((costs, edits))
                totals = counts if counts[0] is not None else totals
            elif kind == 1:
                if audit is None:
                    cost, audit = _joined(parts)
                    parts = []
                    yield from insert()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = SYSTEM if state == START and role[:1] == "s" else NEXT[state]
                    yield "row", conv, position, edit, role, text
                elif edit == "R":
                    state = NEXT[state]
                    yield "row", conv, position, edit, ROLE[state], text
                position += edit != "D"
                yield from insert()
        yield ("batch",)
    if open_:
        yield "end", conv, totals, cost, audit or ""


_EACH = ("conv_id", "kind", "role", "text", "costs", "edits", "blank", "duplicate", "truncated", "illegal", "gaps")
_REPORT = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
_ROWS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, digest, first = [], hashlib.sha256(), True
    for event, *x in _conversations(batches, _EACH):
        if event == "row":
            _, position, _, role, text = x
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        elif event == "end":
            conv, totals, cost, audit = x
            blank, duplicate, truncated, illegal, gaps = totals or [0] * 5
            out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
        else:
            yield _batch(out, _REPORT)
            out = []
    yield _batch(out, _REPORT)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for event, *x in _conversations(batches, _EACH):
        if event == "row":
            out.append(tuple(x))
        elif event == "batch":
            yield _batch(out, _ROWS)
            out = []
    yield _batch(out, _ROWS)


def _solved(rows: DataFrame, every: DataFrame | None) -> DataFrame:
    """Each conversation's solved segments, then its rows, in one partition and in order."""
    rows = _read(rows)
    narrow = _marked(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "same")
    schema = "conv_id bigint, seg bigint, signature string, single boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, gaps bigint"
    segments = stash(narrow.mapInArrow(_segments, schema), "segments")
    counts = stash(segments.groupBy("single", "signature").agg(F.count("*").alias("n")), "signatures")
    ordered = counts.select("single", "signature").repartitionByRange("single", "signature").sortWithinPartitions("single", "signature")
    solved = stash(ordered.mapInArrow(_solve, "signature string, single boolean, costs array<bigint>, edits array<string>"), "solved")
    key = F.concat(F.col("single").cast("string"), F.lit(":"), F.col("signature"))
    keyed, answers = segments.withColumn("key", key).drop("signature", "single"), solved.select(key.alias("key"), "costs", "edits")
    heads = split_join(keyed, answers, "key", hot=hot_keys(keyed, "key", counts.select(key.alias("key"), "n"))).drop("key")
    parts = heads.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    if every is not None:
        parts = parts.unionByName(every.select(F.col("conv_id").cast("bigint")).distinct().withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "seg", F.col("turn").asc_nulls_first(), "same").select(*_EACH)


def repair_report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of rows(conv_id, turn, role, text): faults, cheapest edits, and the hash of its repair.

    A row's first fault counts: blank, duplicate (its role and text stood in an earlier row) or
    truncated (its last character that is no white space is none of ``.!?``). Edits: K keeps a row, R
    gives it the role user or assistant (1), D deletes it (2; blank and duplicate rows have to go), I
    inserts an empty row (5); a truncated row that stays costs 5 more. The roles' initials must then
    form ``(s?(ua)+)?``. Of equally cheap edits the ASCII-least are taken. gaps is the number of turns
    missing between the least and the greatest.

    Null role or text: one space. Null turn: before the others, and in no gap. Null conv_id: one
    conversation. Rows of the same turn stand in an order that hangs on role and text alone; repeated
    rows are duplicates of the first. Ids of ``every`` (any rows with a conv_id) that have no row get
    zeros, empty edits and the hash of the empty text. An empty table gives no rows; other columns are
    ignored. Texts of any length are streamed; their hash is made in one task a conversation, as
    SHA-256 cannot be split.
    """
    return _solved(rows, every).mapInArrow(_report, REPORT)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, edit (K, R or I), role and text; for nulls and ties see repair_report."""
    return _solved(rows, None).mapInArrow(_repaired, REPAIRED)
