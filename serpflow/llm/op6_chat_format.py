"""Chat formatting with a grammar round trip.

Grammar: a conversation is a run of turns; what a turn looks like depends on its role.

    user       <s>[INST] text [/INST]
    assistant  [OUT] text </s>
    system     <<SYS>> text <</SYS>>
    any other  [ROLE]role[/ROLE] text [/TURN]

A text ends at the first closing mark.  A backslash makes the character after it plain.  Each turn is
rendered as it is, parsed again, and kept if the parser gives back exactly its role and text; otherwise
the marks' first characters and backslashes in it are escaped and it is parsed again.

Turns are rendered where the scan put them; then conversations are dealt out by id and streamed in turn
order, so a long conversation is never held as one group.  The stream parses the assembled text again and
compares what it recovers with the source.

Defined results: a null text is empty; a null role is the empty role; turns are ordered by turn (nulls
first), ties and repeated rows by role and text; null conv_id is a conversation of its own; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_CLOSE = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE] ", " [/TURN]")
#: What the escape guards: the first characters of the marks, blanks before closing marks, itself.
SPECIAL = re.compile(r"[\\<\[]")
ESCAPED = re.compile(r"\\(.)", re.S)


def closing(mark: str) -> re.Pattern:
    """An escaped character or the closing mark, whichever comes first."""
    return re.compile(r"\\.|(" + re.escape(mark) + ")", re.S)


CLOSERS = {mark: closing(mark) for mark in [c for _, c in OPEN_CLOSE.values()] + list(OTHER[1:])}


def until(buf: str, at: int, mark: str) -> tuple[str, int] | None:
    """Text from at to the closing mark, unescaped, and the place behind it."""
    for m in CLOSERS[mark].finditer(buf, at):
        if m[1]:
            return ESCAPED.sub(r"\1", buf[at : m.start()]), m.end()
    return None


def parse_turn(buf: str, at: int = 0) -> tuple[str, str, int] | None:
    """(role, text, place behind it) of the turn that begins at a place, None if none does."""
    for role, (opening, mark) in OPEN_CLOSE.items():
        if buf.startswith(opening, at):
            got = until(buf, at + len(opening), mark)
            return got and (role, *got)
    if buf.startswith(OTHER[0], at):
        role = until(buf, at + len(OTHER[0]), OTHER[1])
        if role:
            text = until(buf, role[1], OTHER[2])
            return text and (role[0], *text)
    return None


def parse(buf: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation; ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(buf):
        got = parse_turn(buf, at)
        if got is None:
            raise ValueError(f"no turn at {at}")
        turns.append(got[:2])
        at = got[2]
    return turns


def render(role: str, text: str) -> str:
    """The turn in the template, escaped no more than the round trip asks for."""
    def put(role: str, text: str) -> str:
        if source_role in OPEN_CLOSE:
            opening, mark = OPEN_CLOSE[source_role]
            return opening + text + mark
        return OTHER[0] + role + OTHER[1] + text + OTHER[2]

    source_role = role
    guard = lambda s: SPECIAL.sub(lambda m: "\\" + m[0], s)
    for r, t in ((role, text), (role, guard(text)), (guard(role), guard(text))):
        out = put(r, t)
        if parse_turn(out) == (role, text, len(out)):
            return out
    raise AssertionError("escaping did not make the turn parse")


def render_turns(conversations: DataFrame) -> DataFrame:
    """Add piece, the formatted turn, to conversations (conv_id, turn, role, text)."""

    @F.pandas_udf("string")
    def piece(role, text):
        import pandas as pd

        return pd.Series([render(r, t) for r, t in zip(role, text)], dtype=object)

    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("piece", piece("role", "text"))


RESULT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("round_trip", pa.bool_())])


class Reader:
    """Reads one formatted conversation piece by piece, holding no more than an unfinished turn."""

    def __init__(self):
        self.buf, self.turns, self.chars, self.loss_chars, self.same = "", 0, 0, 0, True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, role: str, text: str) -> None:
        self.chars += len(piece)
        self.buf += piece
        at = 0
        found = []
        while at < len(self.buf) and (got := parse_turn(self.buf, at)):
            found.append(got[:2])
            at = got[2]
        self.buf = self.buf[at:]
        self.same &= found == [(role, text)]
        for r, t in found:
            self.turns += 1
            self.all.update(f"{r}\n{t}\n".encode())
            if r == "assistant":
                self.loss_chars += len(t)
                self.loss.update(t.encode())

    def row(self, conv_id) -> tuple:
        return (conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.same and not self.buf)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text; round_trip tells whether every turn was
    recovered as it was."""
    pieces = render_turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def read_back(batches):
        now, reader, rows = None, None, []
        for batch in batches:
            for conv_id, role, text, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv_id != now:
                    if reader is not None:
                        rows.append(reader.row(now))
                    now, reader = conv_id, Reader()
                reader.feed(piece, role, text)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(RESULT.names, r)) for r in rows], RESULT)
                rows = []
        if reader is not None:
            rows.append(reader.row(now))
        yield pa.RecordBatch.from_pylist([dict(zip(RESULT.names, r)) for r in rows], RESULT)

    return pieces.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "piece").mapInArrow(
        read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, round_trip boolean"
    )
