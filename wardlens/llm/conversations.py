"""Repair of the turn structure of conversations by a run-length dynamic program.

Turns become symbols (initial of the role, fault); equal neighbours collapse to runs. What a row costs is a min-plus
matrix over the four states of the wanted form ``(s?(ua)+)?``; a run multiplies the costs by cached binary powers of its
matrix. The choices are then unrolled, which gives one letter per edit: Delete, Insert, Keep, Rerole.

Texts are not needed to decide: a narrow table (one row per different turn of a conversation, with a count) is sorted by
range, so that a conversation of any size spreads over many tasks, and leaves as segments of runs. Only segments of a
conversation come together, nine bytes a run; texts meet their edits as a sorted stream. What one cell must hold is what the
result asks for: one letter per edit.

Nulls: a null role or text is one space, a null turn comes first, rows with a null conversation are one conversation. Equal
turns are ordered by role, then by the SHA-256 of the text. Repeated rows are faults like any other. Empty tables give no rows.
Columns beyond the four are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Runs of a segment at most.
SEGMENT = 1 << 16

_NEVER = 1 << 60
# States of the wanted form: nothing yet, after s, after u, after a; the state after an inserted or reroled row.
_ENDS = (0, 3)
_NEXT = (2, 2, 3, 2)
# Symbols: 0 must go; 1 to 4 are roles with s, u, a and other initials; 5 to 8 the same with a truncated text.
_INITIALS = {"s": 1, "u": 2, "a": 3}
_GOES_ON = frozenset(("su", "ua", "au"))

Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]

# --- the dynamic program over runs ------------------------------------------------------------------------------


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of a row, without inserted rows before it, by letter."""
    found = [("D", DELETE, state)]
    if symbol:
        initial, more = (symbol - 1) % 4 + 1, TRUNCATED if symbol > 4 else 0
        if initial == 1 and state == 0:
            found.append(("K", more, 1))
        elif initial == 2 and state != 2 or initial == 3 and state == 2:
            found.append(("K", more, _NEXT[state]))
        found.append(("R", REROLE + more, _NEXT[state]))
    return found


def _with_inserts(costs: Sequence[int]) -> Costs:
    """Costs where rows may be inserted first; a third insert only repeats a state."""
    once = [min(costs[s], INSERT + costs[_NEXT[s]]) for s in range(4)]
    return tuple(min(once[s], INSERT + once[_NEXT[s]]) for s in range(4))


#: Costs of a conversation's end by state: inserted rows may complete it.
FINAL = _with_inserts([0 if s in _ENDS else _NEVER for s in range(4)])


def _step_matrix(symbol: int) -> Matrix:
    columns = []
    for target in range(4):
        costs = [min((c for _, c, to in _choices(symbol, s) if to == target), default=_NEVER) for s in range(4)]
        columns.append(_with_inserts(costs))
    return tuple(zip(*columns, strict=True))


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_NEVER, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def _times(a: Matrix, costs: Costs) -> Costs:
    c0, c1, c2, c3 = costs
    return tuple(min(r[0] + c0, r[1] + c1, r[2] + c2, r[3] + c3) for r in a)


# Binary powers of the matrix of each symbol, as far as met.
_POWERS: list[list[Matrix]] = [[_step_matrix(s)] for s in range(9)]
# Costs before a run from costs after it, both less the smallest, and the difference of the smallest ones.
_BEFORE: dict[tuple[int, int, Costs], tuple[int, Costs]] = {}


def before_run(symbol: int, length: int, after: Costs) -> Costs:
    """The cheapest cost from each state before a run, from the costs after it."""
    least = min(after)
    key = (symbol, length, tuple(c - least for c in after))
    found = _BEFORE.get(key)
    if found is None:
        powers, costs, k = _POWERS[symbol], key[2], 0
        while length >> k:
            if k == len(powers):
                powers.append(_product(powers[-1], powers[-1]))
            if length >> k & 1:
                costs = _times(powers[k], costs)
            k += 1
        low = min(costs)
        found = low, tuple(c - low for c in costs)
        if len(_BEFORE) < 100_000:
            _BEFORE[key] = found
    return tuple(least + found[0] + c for c in found[1])


def _unroll_run(symbol: int, length: int, state: int, after: Costs, letters: list[str]) -> int:
    """Append the letters of a run's edits to ``letters``; the state after it. Halves are unrolled one after the other."""
    waiting = [(length, after)]
    while waiting:
        length, after = waiting.pop()
        if length > 1:
            half = length // 2
            waiting += [(half, after), (length - half, before_run(symbol, half, after))]
            continue
        here = before_run(symbol, 1, after)
        while True:
            options = [(letter, to) for letter, cost, to in _choices(symbol, state) if cost + after[to] == here[state]]
            if INSERT + here[_NEXT[state]] == here[state]:
                options.append(("I", _NEXT[state]))
            letter, state = min(options)
            letters.append(letter)
            if letter != "I":
                break
    return state


def edits(segments: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of a conversation given as (symbols, lengths) of runs by segment.

    Of equally cheap edits the least string of letters. Costs are kept per segment and computed again within one.
    """
    after = [FINAL]
    for symbols, lengths in reversed(segments):
        costs = after[-1]
        for symbol, length in zip(symbols[::-1].tolist(), lengths[::-1].tolist(), strict=True):
            costs = before_run(symbol, length, costs)
        after.append(costs)
    cost = after.pop()[0]
    letters: list[str] = []
    pieces: list[str] = []
    state = 0
    for symbols, lengths in segments:
        runs = list(zip(symbols.tolist(), lengths.tolist(), strict=True))
        ends = [after.pop()]
        for symbol, length in reversed(runs[1:]):
            ends.append(before_run(symbol, length, ends[-1]))
        for (symbol, length), end in zip(runs, reversed(ends)):
            state = _unroll_run(symbol, length, state, end, letters)
        pieces.append("".join(letters))
        letters.clear()
    while state not in _ENDS:
        state = _NEXT[state]
        pieces.append("I")
    return cost, "".join(pieces)


# --- damage of the query ----------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) after the query's damage by crc32 of ``conv:turn``; a dropped row has no copies."""

    def blank(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(F.col(role)).alias("role"), blank(F.col(text)).alias("text"))
    kind = F.crc32(F.concat(blank(F.col("conv")), F.lit(":"), blank(F.col("turn"))).cast("binary")) % 20
    return rows.withColumn("kind", kind).select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def as_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Any table of turns in the form the operator takes: (conv, turn, role, text, copies)."""
    blank = F.lit(" ")
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"), F.lit(1).alias("copies"),
    )


# --- symbols and segments -----------------------------------------------------------------------------------------


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _symbol_rows(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, n, blank, truncated, first): one row per different turn of a conversation.

    ``first``: the text was not seen before with this role. Equal turns are counted before they leave their task. A
    dropped row leaves one row without copies per conversation, so that no conversation is lost.
    """
    there = F.col("copies") > 0
    rows = turns.select(
        "conv",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.col("role")).otherwise("").alias("role"),
        F.when(there, _digest(F.col("text"))).otherwise(F.lit(b"")).alias("digest"),
        "copies",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    one = rows.groupBy("conv", "turn", "role", "digest").agg(
        F.sum("copies").alias("n"), F.min("blank").alias("blank"), F.min("truncated").alias("truncated")
    )
    one = stored(one, "turns")
    # written first: a text that a conversation repeats at many turns can then be split in the join
    again = one.filter((F.col("n") > 0) & ~F.col("blank")).groupBy("conv", "role", "digest").agg(
        F.count(F.lit(1)).alias("places"), F.max(F.col("turn").isNull()).alias("early"), F.min("turn").alias("low")
    )
    again = stored(again.filter(F.col("places") > 1).drop("places"), "again")
    a, b = one.alias("a"), again.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    first = F.col("b.early").isNull() | F.col("a.turn").isNull() | (~F.col("b.early") & (F.col("a.turn") == F.col("b.low")))
    return a.join(b, same, "left").select("a.*", first.alias("first"))


_SEGMENT_FIELDS = (
    "symbols binary, lengths binary, rows long, blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, high long, first_turn long, last_turn long, first_role string, last_role string"
)


class _Segment:
    """Runs and counts of neighbouring turns of one conversation."""

    def __init__(self, conv, turn, role, digest) -> None:
        self.key = (conv, turn, role, digest)
        self.symbols = bytearray()
        self.lengths: list[int] = []
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, symbol: int, n: int) -> None:
        if self.lengths and self.symbols[-1] == symbol:
            self.lengths[-1] += n
        else:
            self.symbols.append(symbol)
            self.lengths.append(n)

    def take(self, turn, role: str, n: int, blank: bool, truncated: bool, first: bool) -> None:
        if not n:
            return
        initial = role[:1]
        if not self.rows:
            self.first_turn, self.first_role = turn, initial
        elif self.last_role + initial not in _GOES_ON:
            self.illegal += 1
        self.illegal += n - 1
        self.last_role = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn
        self.last_turn = turn
        self.rows += n
        if blank:
            self.blank += n
            self.add(0, n)
            return
        if first:
            self.truncated += truncated
            self.add(_INITIALS.get(initial, 4) + 4 * truncated, 1)
            n -= 1
        if n:
            self.duplicate += n
            self.add(0, n)

    def row(self) -> tuple:
        return (
            *self.key, bytes(self.symbols), np.array(self.lengths, "<i8").tobytes(), self.rows, self.blank, self.duplicate, self.truncated,
            self.illegal, self.turns, self.low, self.high, self.first_turn, self.last_turn, self.first_role, self.last_role,
        )


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(conv: pa.DataType, fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([("conv", conv), *[(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))]])


def _to_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``_symbol_rows`` -> segments; a conversation may go on in the next task."""
    segment, out, schema = None, [], None
    for batch in batches:
        schema = schema or _arrow(batch.column(0).type, "turn long, role string, digest binary, " + _SEGMENT_FIELDS)
        for conv, turn, role, digest, n, blank, truncated, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment is None or segment.key[0] != conv or len(segment.lengths) >= SEGMENT:
                if segment is not None:
                    out.append(segment.row())
                segment = _Segment(conv, turn, role, digest)
            segment.take(turn, role, n, blank, truncated, first)
        if out:
            yield _batches(out, schema)
            out = []
    if segment is not None:
        yield _batches([segment.row()], schema)


_SUMMARY_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summary(conv, segments: list[dict]) -> tuple:
    """One conversation from its segments in order."""
    segments = [s for s in segments if s["rows"]]
    if not segments:
        return conv, 0, 0, 0, 0, 0, 0, ""
    illegal = sum(s["illegal"] for s in segments)
    turns = sum(s["turns"] for s in segments)
    for a, b in zip(segments, segments[1:]):
        illegal += a["last_role"] + b["first_role"] not in _GOES_ON
        turns -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low = [s["low"] for s in segments if s["low"] is not None]
    high = [s["high"] for s in segments if s["high"] is not None]
    gaps = max(high) - min(low) + 1 - turns if low else 0
    cost, audit = edits([(np.frombuffer(s["symbols"], np.uint8), np.frombuffer(s["lengths"], "<i8")) for s in segments])
    return conv, gaps, *(sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit


def _to_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments -> one row per conversation; all segments of one are in the same task."""
    held: list[dict] = []
    out, size, schema = [], 0, None
    for batch in batches:
        schema = schema or _arrow(batch.column(0).type, _SUMMARY_FIELDS)
        for row in batch.to_pylist():
            if held and held[0]["conv"] != row["conv"]:
                out.append(_summary(held[0]["conv"], held))
                size += len(out[-1][-1])
                held = []
                if size > 1 << 22 or len(out) == 10_000:
                    yield _batches(out, schema)
                    out, size = [], 0
            held.append(row)
    if held:
        out.append(_summary(held[0]["conv"], held))
    if out:
        yield _batches(out, schema)


def summaries(turns: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows (conv, turn, role, text, copies)."""
    kind = turns.schema["conv"].dataType.simpleString()
    key = ["conv", "turn", "role", "digest"]
    rows = _symbol_rows(turns).select(*key, "n", "blank", "truncated", "first")
    parted = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    segments = parted.mapInArrow(_to_segments, f"conv {kind}, turn long, role string, digest binary, {_SEGMENT_FIELDS}")
    together = segments.repartition("conv").sortWithinPartitions(*key)
    return together.mapInArrow(_to_summaries, f"conv {kind}, {_SUMMARY_FIELDS}")


# --- texts meet their edits ---------------------------------------------------------------------------------------

_TURN_FIELDS = "position long, edit string, role string, text string, " + _SUMMARY_FIELDS


class _Edited:
    """A conversation on its way through the stream: its letters and how far they are used."""

    def __init__(self, conv, audit: str) -> None:
        self.conv, self.audit = conv, audit
        self.at = self.position = self.state = 0

    def put(self, edit: str, role: str, text: str) -> tuple:
        self.position += 1
        return (self.conv, self.position, edit, role, text, *[None] * 7)

    def new_role(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == 2 else "assistant"

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.put("I", self.new_role(), "")

    def take(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = 1 if role[:1] == "s" else _NEXT[self.state]
            yield self.put("K", role, text)
        elif letter == "R":
            yield self.put("R", self.new_role(), text)


def _to_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stream of a summary and its turns -> the summary (position 0) and the repaired turns in order."""
    current, schema = None, None
    for batch in batches:
        schema = schema or _arrow(batch.column(0).type, _TURN_FIELDS)
        out, size = [], 0
        for conv, kind, _, role, _, text, copies, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                if current is not None:
                    out.extend(current.inserts())
                current = _Edited(conv, found[-1])
                out.append((conv, 0, None, None, None, *found))
                continue
            for _ in range(copies):
                out.extend(current.take(role, text))
            size += len(text)
            if size > 1 << 22:
                yield _batches(out, schema)
                out, size = [], 0
        if out:
            yield _batches(out, schema)
    if current is not None and (rest := list(current.inserts())):
        yield _batches(rest, schema)


def _stream(turns: DataFrame) -> DataFrame:
    """Summaries (position 0) and repaired turns, each conversation in one partition and in order of position."""
    kind = turns.schema["conv"].dataType.simpleString()
    turns = stored(turns, "damaged")
    names = [f.split()[0] for f in _SUMMARY_FIELDS.split(", ")]
    found = summaries(turns).select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), *names,
    )
    nothing = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _SUMMARY_FIELDS.split(", ")]
    texts = turns.filter("copies > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text", "copies", *nothing)
    order = ["conv", "kind", "turn", "role", "digest"]
    return found.unionByName(texts).repartition("conv").sortWithinPartitions(*order).mapInArrow(_to_turns, f"conv {kind}, {_TURN_FIELDS}")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv, position, edit, role, text): the turns that stay, with new roles, and the inserted ones."""
    return _stream(turns).filter("position > 0").select("conv", "position", "edit", "role", "text")


def _to_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream of ``_stream`` -> summaries with a running SHA-256 of ``role:text`` lines; no text is gathered."""
    found, sha, schema = None, None, None
    for batch in batches:
        schema = schema or _arrow(batch.column(0).type, _SUMMARY_FIELDS + ", repaired_sha256 string")
        out = []
        conv, position, role, text = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for k, at in enumerate(position):
            if at == 0:
                if found is not None:
                    out.append((*found, sha.hexdigest()))
                found, sha = (conv[k], *(batch.column(c)[k].as_py() for c in range(5, 12))), hashlib.sha256()
            else:
                sha.update(f"{chr(10) if at > 1 else ''}{role[k]}:{text[k]}".encode())
        if out:
            yield _batches(out, schema)
    if found is not None:
        yield _batches([(*found, sha.hexdigest())], schema)


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the query. A SHA-256 is one chain: the texts of a conversation pass one task as a stream."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = _stream(damaged(conversations)).mapInArrow(_to_digests, f"conv {kind}, {_SUMMARY_FIELDS}, repaired_sha256 string")
    return rows.withColumnRenamed("conv", "conv_id")
