"""Conversation repair: the cheapest edits that make the turns of a conversation alternate properly.

Rows of a conversation, by turn, may each be kept, re-roled or deleted, and empty turns inserted, so that the
role initials read ``(s?(ua)+)?``.  Cheapest wins, and among equal costs the ASCII-least audit (the initials
of the edits in order).

Every way to repair is a path in a graph of (row, grammar state, turns inserted there), and every edit has one
whole number as its weight: the high digits carry the cost; below them, ``WIDTH`` digits of three bits carry
the letter of the edit at its place in the audit, earlier letters in higher digits, zero where the audit has
ended.  A path's sum of weights therefore orders by cost, then by audit, a prefix before what it begins, and a
plain minimum over integers from the last row to the first decides everything.

Long conversations are decided in blocks of ``BLOCK`` rows, last block first, so numbers stay short.  What a
block needs to know of the rows behind it is, for each state, the cost and how the audits from there on rank;
the rank is one more digit after the block's letters.  No audit of a block is a proper prefix of another's of
that block, as each ends in the letter of its last row, so the rank decides exactly between equal letters.

On Spark: rows are reduced to their faults and ids (no text), sorted by conversation and turn, and streamed, so
a task holds one byte for a row of the conversation at hand.  The audits then meet the whole rows, sorted
likewise, which are hashed as they stream by.  A conversation's hash is by nature one pass over its text.

Defined results: a null conv_id is one conversation of its own.  Null turns come first; rows of one turn are
ordered by a hash of role and text, repeated rows stand together.  Null roles and texts count as one space, so
such roles are no legal initial and such texts are blank.  An empty table gives no rows.  Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import attach, bounded_batches, stored

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Grammar states: nothing yet, after s, after u, after a; what each may take next; which may end.
START, S, U, A = range(4)
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
FINAL = (START, A)
#: The one turn that can be inserted or re-roled in each state.
TURN = {START: "u", S: "u", U: "a", A: "u"}
ROLE = {"u": "user", "a": "assistant"}

#: A row is one byte: its initial (x where it is none of the grammar's), in upper case where the text is
#: truncated; ``-`` where the row must be deleted.
MUST_DELETE = b"-"[0]

#: Rows decided at once.
BLOCK = 64
#: Digits below the cost: up to two insertions before each row, the row's letter, and the rank behind.
WIDTH = 3 * BLOCK + 1
BITS = 3
LETTERS = "DIKR"
_DIGIT = {c: i + 1 for i, c in enumerate(LETTERS)}
_FIRST = BITS * (WIDTH - 1)
_COST = BITS * WIDTH
_AUDIT = (1 << _COST) - 1

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


# --- the decision ---------------------------------------------------------------------------


def _edit(letter: str, cost: int) -> int:
    """Weight of an edit whose letter stands first."""
    return (cost << _COST) + (_DIGIT[letter] << _FIRST)


def _later(value: int) -> int:
    """A path's number with its letters one place later, so that another letter can come first."""
    audit = value & _AUDIT
    return value - audit + (audit >> BITS)


_INSERT, _DELETE = _edit("I", INSERT), _edit("D", DELETE)


def _with_insertions(values: list[int]) -> list[int]:
    """The least numbers where up to two turns are inserted first (a third comes back to a state)."""
    best = values
    for _ in range(2):
        best = [min(v, _INSERT + _later(best[NEXT[q][TURN[q]]])) for q, v in enumerate(values)]
    return best


def _before(symbols: bytes, after: list[int]) -> list[int]:
    """The least numbers of the four states before a block, from those behind it."""
    values = after
    for symbol in reversed(symbols):
        moved = [_later(v) for v in values]
        rows = [_DELETE + m for m in moved]
        if symbol != MUST_DELETE:
            c = chr(symbol)
            extra = TRUNCATED if c.isupper() else 0
            keep, rerole = _edit("K", KEEP + extra), _edit("R", REROLE + extra)
            for q in range(4):
                rows[q] = min(rows[q], rerole + moved[NEXT[q][TURN[q]]])
                if c.lower() in NEXT[q]:
                    rows[q] = min(rows[q], keep + moved[NEXT[q][c.lower()]])
        values = _with_insertions(rows)
    return values


def _ranked(values: list[int]) -> tuple[list[int], int]:
    """The least cost, and numbers of the same order: cost above it, and the audit's rank (from 1) as a digit."""
    least = min(values) >> _COST
    audits = sorted({v & _AUDIT for v in values})
    return [((v >> _COST) - least << _COST) + (audits.index(v & _AUDIT) + 1 << _FIRST) for v in values], least


def _audit(value: int) -> str:
    """The letters of a number."""
    out, shift = [], _FIRST
    while shift >= 0 and (digit := value >> shift & 7):
        out.append(LETTERS[digit - 1])
        shift -= BITS
    return "".join(out)


def decide(symbols: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation whose rows are ``symbols``."""
    blocks = [symbols[i : i + BLOCK] for i in range(0, len(symbols), BLOCK)]
    never = 100 << _COST  # dearer than the two insertions that end any conversation
    values = _with_insertions([0 if q in FINAL else never for q in range(4)])
    tails = [_audit(v) for v in values]
    cost, starts = 0, []
    for part in reversed(blocks):
        values, least = _ranked(values)
        cost += least
        values = _before(part, values)
        starts.append(values)
    cost += values[START] >> _COST
    state, audit = START, []
    for part, before in zip(blocks, reversed(starts)):
        letters = _audit(before[state])[:-1]  # the last digit is the rank behind
        audit.append(letters)
        for _, state in _steps(part, letters, state):
            pass
    return cost, "".join(audit) + tails[state]


def _steps(symbols, letters: str, state: int):
    """Role initial that each edit gives (None for a deletion), and the state after it."""
    rows = iter(symbols)
    for letter in letters:
        symbol = None if letter == "I" else next(rows)
        if letter == "D":
            yield None, state
            continue
        initial = chr(symbol).lower() if letter == "K" else TURN[state]
        state = NEXT[state][initial]
        yield initial, state


# --- rows -----------------------------------------------------------------------------------


def _rows(conv: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``key``, which tells apart what one conversation says."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    named = conv.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return named.withColumn("key", F.unhex(F.sha2(said, 256)))


def _symbol() -> tuple[Column, Column, Column]:
    """The row's byte as a letter, and whether its text is blank or truncated."""
    text = F.rtrim("text", F.lit(SPACE))
    blank = text == ""
    cut = ~blank & ~F.substring(text, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(cut, F.upper(initial)).otherwise(initial), blank, cut


def _by_conversation(rows: DataFrame, *order) -> DataFrame:
    keys = [F.col("conv_id").asc_nulls_first(), *order]
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


def audits(conv: DataFrame) -> DataFrame:
    """One row per conversation of ``conv`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit."""
    symbol, blank, cut = _symbol()
    rows = _rows(conv).select("conv_id", F.col("turn").cast("long").alias("turn"), "key", symbol.alias("symbol"), blank.alias("blank"), F.substring("role", 1, 1).alias("initial"))
    rows = stored(rows, "turns")
    total = rows.count()
    said = rows.groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    rows = attach(rows, said, "key", "times", total)
    rows = rows.select("conv_id", "turn", "key", "symbol", "blank", "initial", F.col("times").isNotNull().alias("again"), F.col("first.turn").alias("first"))
    conv_type = conv.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out, one = [], None
        for batch in batches:
            ids, *cols = (c.to_pylist() for c in batch.columns)
            for conv_id, row in zip(ids, zip(*cols)):
                if one is None or one.conv_id != conv_id:
                    if one is not None:
                        out.append(one.result())
                    one = _Conversation(conv_id)
                one.add(*row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if one is not None:
            yield pa.RecordBatch.from_pylist([one.result()], schema=schema)

    added = [*COUNTS, "cost"]
    result = f"conv_id {conv_type}, " + ", ".join(f"{c} long" for c in added) + ", audit string"
    schema = pa.schema([("conv_id", _arrow(conv, "conv_id")), *[(c, pa.int64()) for c in added], ("audit", pa.string())])
    return _by_conversation(rows, F.col("turn").asc_nulls_first(), "key").mapInArrow(run, result)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


class _Conversation:
    """What is kept of the conversation that streams by: a byte a row, and counts."""

    LEGAL = ("su", "ua", "au")

    def __init__(self, conv_id):
        self.conv_id, self.symbols = conv_id, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn, key, symbol, blank, initial, again, first):
        repeated = again and (turn != first or self.last is not None and self.last[:2] == (turn, key))
        if blank or repeated:
            self.blank += blank
            self.duplicate += not blank
            self.symbols.append(MUST_DELETE)
        else:
            self.truncated += symbol.isupper()
            self.symbols += symbol.encode()
        if self.last is not None and self.last[2] + initial not in self.LEGAL:
            self.illegal += 1
        if turn is not None:
            if self.last is None or self.last[0] != turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last = (turn, key, initial)

    def result(self) -> dict:
        cost, audit = decide(bytes(self.symbols))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = [gaps, self.blank, self.duplicate, self.truncated, self.illegal]
        return {"conv_id": self.conv_id, **dict(zip(COUNTS, counts)), "cost": cost, "audit": audit}


def repair(conv: DataFrame, decided: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), role, text, by conversation and position in each
    partition.  ``decided`` is the result of :func:`audits` on the same rows.

    A conversation's audit comes before its rows, which are edited one by one as they stream by."""
    bounded_batches(conv.sparkSession)
    rows = _rows(conv).select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "key", "role", "text")
    heads = decided.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = _by_conversation(heads.unionByName(rows), "kind", F.col("turn").asc_nulls_first(), "key").select("conv_id", "kind", "role", "text")
    schema = pa.schema([("conv_id", _arrow(conv, "conv_id")), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        conv_id, edits, state, at = None, iter(()), START, 0
        for batch in batches:
            out = []

            def put(role, text):
                nonlocal at
                out.append((conv_id, at, role, text))
                at += 1

            for row_id, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    for _ in edits:  # what is inserted behind the last row
                        put(ROLE[TURN[state]], "")
                        state = NEXT[state][TURN[state]]
                    conv_id, edits, state, at = row_id, iter(text), START, 0
                    continue
                while (edit := next(edits)) == "I":
                    put(ROLE[TURN[state]], "")
                    state = NEXT[state][TURN[state]]
                if edit != "D":
                    put(role if edit == "K" else ROLE[TURN[state]], text)
                    state = NEXT[state][role[0] if edit == "K" else TURN[state]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        out = []
        for _ in edits:
            out.append((conv_id, at + len(out), ROLE[TURN[state]], ""))
            state = NEXT[state][TURN[state]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return both.mapInArrow(run, f"conv_id {conv.schema['conv_id'].dataType.simpleString()}, position long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of the ``role:text`` lines of each conversation that has rows, hashed as they stream by.

    ``repaired`` is the result of :func:`repair` as it comes: its partitions hold conversations whole and in order."""
    schema = pa.schema([("conv_id", _arrow(repaired, "conv_id")), ("sha256", pa.string())])

    def run(batches):
        conv_id, state = None, None
        for batch in batches:
            out = []
            for row_id, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at == 0:
                    if state is not None:
                        out.append({"conv_id": conv_id, "sha256": state.hexdigest()})
                    conv_id, state = row_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "sha256": state.hexdigest()}], schema=schema)

    return repaired.mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, sha256 string")


# --- damage, to have something to repair ----------------------------------------------------


def damage(conv: DataFrame) -> DataFrame:
    """``conv`` with every twentieth row or so, by a checksum of its id and turn, dropped, emptied, stripped of
    its sentence ends, repeated, or given the user's role.  Nulls count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    rows = conv.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")
