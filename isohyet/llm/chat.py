"""Operator 2: chat formatting with a grammar round trip.

    conversation := "<s>" turn*
    turn         := "[INST] " text " [/INST]"                    role user
                  | " " text "</s>"                              role assistant
                  | "<<SYS>>" text "<</SYS>>"                    role system
                  | "<<ROLE>>" role "<</ROLE>>" text "<</TURN>>"  any other role

Inside a text the parser reads a backslash before a backslash, "<" or "[" as that
character itself.  A turn is first rendered as it is and parsed back; if another turn comes
out, its text is escaped (every backslash, "<" and "[") and parsed again.  A turn's
parse ends at its own closing mark and does not look beyond, so turns that come back identical
one by one also do so in sequence; `parse` reads whole conversations as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\([\\<\[])")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _until(data: str, at: int, mark: str) -> tuple[str, int] | None:
    """Unescaped text up to the first mark that is not escaped, and the place after it."""
    end = data.find(mark, at)
    slash = data.find("\\", at)
    if end >= 0 and (slash < 0 or slash > end):
        return data[at:end], end + len(mark)
    first, p = at, at
    while True:
        slash = data.find("\\", p)
        end = data.find(mark, p)
        if end >= 0 and (slash < 0 or end < slash):
            return unescape(data[first:end]), end + len(mark)
        if slash < 0:
            return None
        p = slash + (2 if data[slash + 1 : slash + 2] in ("\\", "<", "[") and slash + 1 < len(data) else 1)


def parse_turn(data: str, at: int = 0) -> tuple[str, str, int] | None:
    """(role, text, end) of the turn at a place; None if it is not complete there."""
    if data.startswith(OTHER[0], at):
        role = _until(data, at + len(OTHER[0]), OTHER[1])
        text = role and _until(data, role[1], OTHER[2])
        return text and (role[0], text[0], text[1])
    for role, (begin, end) in MARKS.items():
        if data.startswith(begin, at):
            text = _until(data, at + len(begin), end)
            return text and (role, text[0], text[1])
    return None


def _render(role: str, text: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + text + MARKS[role][1]
    return OTHER[0] + escape(role) + OTHER[1] + text + OTHER[2]


def render_turn(role: str, text: str) -> str:
    """The turn as it is if it parses back identical, else escaped."""
    for written in (text, escape(text)):
        piece = _render(role, written)
        if parse_turn(piece) == (role, text, len(piece)):
            return piece
    raise AssertionError("an escaped turn always parses back")


def parse(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Turns of one formatted conversation that comes in pieces of any size; holds one turn."""
    held, begun = "", False
    for piece in pieces:
        held += piece
        if not begun:
            if len(held) < len(BEGIN):
                continue
            if not held.startswith(BEGIN):
                raise ValueError("a conversation begins with " + BEGIN)
            held, begun = held[len(BEGIN) :], True
        at = 0
        while at < len(held) and (turn := parse_turn(held, at)):
            yield turn[:2]
            at = turn[2]
        held = held[at:]
    if held or not begun:
        raise ValueError("an incomplete conversation")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        turns = zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)
        piece = pa.array([render_turn(r, t) for r, t in turns], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), piece], ["conv_id", "turn", "piece"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, piece): a conversation's text is BEGIN and its pieces by turn, then by piece.

    Null roles and texts count as empty.  Rows with a null conv_id form one conversation, a null turn
    comes first, and repeated rows stay.  Other columns are ignored.  No shuffle: the text of a
    conversation of any length never has to be in one row.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_pieces, "conv_id long, turn long, piece string")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole texts, for conversations that fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform(ordered, lambda x: x["piece"]), ""))
    return format_turns(conversations).groupBy("conv_id").agg(text.alias("formatted"))


class _Digest:
    """What is read back from one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, role: str, text: str) -> None:
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces come sorted; a conversation is parsed as a stream."""
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in DIGEST.split(", "))])
    current: list = []
    held, digest, done = "", None, []

    def take(text: str) -> str:
        at = 0
        while at < len(text) and (turn := parse_turn(text, at)):
            digest.add(turn[0], turn[1])
            at = turn[2]
        return text[at:]

    def close():
        if held:
            raise ValueError(f"conversation {current[0]} does not parse to its end")
        done.append((current[0], *digest.row()))

    for b in batches:
        for conv, piece in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist(), strict=True):
            if not current or current[0] != conv:
                if current:
                    close()
                current, digest, held = [conv], _Digest(), ""
                digest.formatted_chars = len(BEGIN)
            digest.formatted_chars += len(piece)
            held = take(held + piece)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
            done.clear()
    if current:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation with what its formatted text says: see DIGEST.

    A conversation is one sequence, hashed in order, so its pieces meet in one task; they are
    sorted by Spark (which spills) and parsed as a stream, with one turn in memory.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "piece")
    return rows.mapInArrow(_read_back, DIGEST)
