"""Operator 13: repair of conversation structure by aligning turns with the alternating grammar `(s?(ua)+)?`.

The legal role strings of each length are one or two: `uaua...` with or without a leading `s`.  Wagner-Fischer aligns the turns
with the longest of them; the last row of its table has the cost of every feasible length, because the shorter ones are prefixes.
Ukkonen bands leave out cells further from the diagonal than the cost of an incumbent, a repair found by one
greedy pass, allows.  The cheapest lengths are compared by cost and then by their backtraced audits.

A conversation is read as a stream in blocks of BLOCK turns.  Between blocks only the state of the grammar matters
(nothing yet, after s, after u, after a), so a block is aligned from each state that can be reached to each state, and what is kept per state
is the cost, the audit and the running hash of the repaired text.  Audits that use up the same turns at the same cost are never prefixes of
one another, so the least audit of a conversation is made of least audits of its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1

# states of the grammar: nothing yet, after s, after u, after a; only the first and the last may end a conversation
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = {NOTHING: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
_AFTER = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
_WHOLE = {"u": "user", "a": "assistant"}

Best = dict[int, tuple[int, str]]


# --- alignment of one block -------------------------------------------------
# a turn is one letter: its initial s, u or a, `o` for any other, upper case if it is truncated, `x` if it has to be deleted


def _target(start: str, n: int) -> str:
    """The legal string of n letters that begins with `start`."""
    tail = "ua" if start in "sa" else "au"
    return (start + tail * (n // 2 + 1))[:n]


def incumbent(turns: str, state: int) -> int:
    """Cost beyond the unavoidable of a greedy repair: keep what fits, rerole the rest, end after an a."""
    cost = 0
    for t in turns.lower():
        if t == "x":
            continue
        if t == "s" and state == NOTHING:
            state = AFTER_S
            continue
        cost += REROLE * (t != _NEXT[state])
        state = _AFTER[_NEXT[state]]
    return cost + INSERT * {AFTER_S: 2, AFTER_U: 1}.get(state, 0)


def _align(turns: str, target: str, base: int, bound: int) -> list[tuple[int, str] | None]:
    """Cheapest (cost, audit) of turning all turns into each prefix of the target, None beyond the bound.

    Cells whose cost beyond the unavoidable (`base` over all turns) exceeds the bound are outside the band.
    """
    row: dict[int, tuple[int, str]] = {0: (0, "")}
    for j in range(1, len(target) + 1):
        cost = row[j - 1][0] + INSERT
        if target[j - 1] == "s" or cost > bound:
            break
        row[j] = (cost, row[j - 1][1] + "I")
    sure = 0
    for t in turns:
        forced, late = t == "x", UNFINISHED if t.isupper() else 0
        sure += DELETE if forced else late
        own, now = t.lower(), {}
        for j in range(min(row), len(target) + 1):
            found = []
            if j in row:
                found.append((row[j][0] + DELETE, row[j][1] + "D"))
            if j:
                want = target[j - 1]
                if not forced and j - 1 in row:
                    cost, audit = row[j - 1]
                    if own == want:
                        found.append((cost + late, audit + "K"))
                    elif want != "s":
                        found.append((cost + late + REROLE, audit + "R"))
                if want != "s" and j - 1 in now:
                    found.append((now[j - 1][0] + INSERT, now[j - 1][1] + "I"))
            if found:
                best = min(found)
                if best[0] - sure <= bound:
                    now[j] = best
            elif j > max(row):
                break
        row = now
        if not row:
            break
    assert not row or sure == base
    return [row.get(j) for j in range(len(target) + 1)]


@lru_cache(maxsize=1 << 15)
def repairs(turns: str, state: int) -> Best:
    """Cheapest (cost, audit), ties ASCII-least, from a state of the grammar to every state over a block of turns."""
    base = sum(DELETE if t == "x" else UNFINISHED for t in turns if t == "x" or t.isupper())
    # any end state is at most two inserts from the one the greedy repair ends in
    bound = incumbent(turns, state) + 2 * INSERT
    longest = len(turns) + bound // INSERT
    best: Best = {}
    for start in "su" if state == NOTHING else _NEXT[state]:
        target = _target(start, longest)
        for n, found in enumerate(_align(turns, target, base, bound)):
            end = _AFTER[target[n - 1]] if n else state
            if found and (end not in best or found < best[end]):
                best[end] = found
    # a block may be deleted whole or but for one s; both can cost more than the band allows
    if state in (NOTHING, AFTER_S):
        gone = (DELETE * len(turns), "D" * len(turns))
        best[state] = min(gone, best.get(state, gone))
    if state == NOTHING:
        for i, t in enumerate(turns):
            if t in "sS":
                only = (DELETE * (len(turns) - 1) + (UNFINISHED if t == "S" else 0), "D" * i + "K" + "D" * (len(turns) - i - 1))
                best[AFTER_S] = min(only, best.get(AFTER_S, only))
    return best


# --- streams of conversations -----------------------------------------------

RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_RESULT = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in RESULT.split(", "))])
REPAIRED = "conv_id long, place long, edit string, role string, text string"
_REPAIRED = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in REPAIRED.split(", "))])


def _edits(audit: str, turns: list[tuple], state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns an audit leaves, from a state of the grammar."""
    rows = iter(turns)
    for edit in audit:
        role, text = next(rows)[:2] if edit != "I" else (None, "")
        if edit == "D":
            continue
        if edit != "K":
            role = _WHOLE[_NEXT[state]]
        yield edit, role, text
        state = _AFTER[role[0]]


class _Repair:
    """One conversation read turn by turn."""

    def __init__(self, conv):
        self.conv, self.block = conv, []
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = None
        # by state: cost, audit, hash of the repaired text
        self.live = {NOTHING: (0, "", hashlib.sha256())}

    def add(self, turn, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        self.blank += blank
        self.duplicate += again
        self.truncated += cut
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        letter = role[:1] if role[:1] and role[:1] in "sua" else "o"
        self.block.append((role, text, "x" if blank or again else letter.upper() if cut else letter))
        if len(self.block) == BLOCK:
            self.align()

    def align(self) -> None:
        """Extend every live state over the block."""
        letters, best = "".join(x[2] for x in self.block), {}
        for state, (cost, audit, _) in self.live.items():
            for end, (more, edits) in repairs(letters, state).items():
                way = (cost + more, audit + edits)
                if end not in best or way < best[end][0]:
                    best[end] = (way, state, edits)
        live = {}
        for end, ((cost, audit), state, edits) in best.items():
            sha = self.live[state][2].copy()
            wrote = state != NOTHING
            for _, role, text in _edits(edits, self.block, state):
                sha.update(f"{chr(10) if wrote else ''}{role}:{text}".encode())
                wrote = True
            live[end] = (cost, audit, sha)
        self.live, self.block = live, []

    def row(self) -> tuple:
        self.align()
        cost, audit, sha = min((x for s, x in self.live.items() if s in (NOTHING, AFTER_A)), key=lambda x: x[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, sha.hexdigest()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose turns come sorted; memory holds one block and one audit per state."""
    now, done = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _RESULT, strict=True)], schema=_RESULT)

    for b in batches:
        columns = ("conv_id", "turn", "role", "text", "fault", "gone")
        for conv, turn, role, text, fault, gone in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Repair(conv)
            if not gone:
                now.add(turn, role, text, fault == "blank", fault == "duplicate", fault == "truncated")
        if len(done) >= 1000:
            yield out()
            done.clear()
    if now is not None:
        done.append(now.row())
    if done:
        yield out()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of repaired conversations: an edit of the audit takes the next turn unless it is an insert."""
    now, audit, at, state, place, done = None, "", 0, NOTHING, 0, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _REPAIRED, strict=True)], schema=_REPAIRED)

    def put(edit, role, text):
        nonlocal state, place
        done.append((now[0], place, edit, role, text))
        state, place = _AFTER[role[0]], place + 1

    def inserts():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put("I", _WHOLE[_NEXT[state]], "")
            at += 1

    for b in batches:
        for conv, role, text, gone, edits in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "gone", "audit")), strict=True):
            if now is None or now[0] != conv:
                inserts()
                now, audit, at, state, place = (conv,), edits, 0, NOTHING, 0
            if gone:
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(edit, role if edit == "K" else _WHOLE[_NEXT[state]], text)
        if done:
            yield out()
            done.clear()
    inserts()
    if done:
        yield out()


# --- frames -----------------------------------------------------------------


def _plain(conversations: DataFrame) -> DataFrame:
    """The four columns with null roles and texts as one space; `gone` marks rows that only name their conversation."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(False).alias("gone"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(`conv_id:turn`) % 20: 0 drops (the row stays, marked gone), 1 empties the text, 2 takes out its
    `[.!?]`, 3 repeats the row, 4 makes the role user."""
    rows = _plain(conversations)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), F.when(kind == 0, "").otherwise(text).alias("text"), (kind == 0).alias("gone"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their first fault: blank, duplicate, truncated or null; dealt by conversation.

    One shuffle: the window and the stream that follows both sort the same partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "conv_id").withColumn("digest", F.sha2("text", 256))
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(F.col("gone"), F.lit(None).cast("string")).when(last == "", "blank")
        .when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    )
    return dealt.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault).drop("digest")


def _sorted(rows: DataFrame, *last: str) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", *last)


def repair_audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows with faults: gaps, counts of faults, illegal neighbours, the cheapest repair."""
    # of equal rows the one that is no duplicate comes first
    return _sorted(faults(rows), "nth").mapInArrow(_repair, RESULT)


def repaired(conversations: DataFrame) -> DataFrame:
    """Repaired conversations as turns: conv_id, place (from 0), edit (K, R or I), role, text.

    Conversations that are all deleted have no turns.  Edge cases as in `structure_repair`.
    """
    rows = _plain(conversations)
    audits = repair_audits(rows).select(F.col("conv_id").alias("a_conv"), "audit")
    both = rows.join(audits, rows["conv_id"].eqNullSafe(audits["a_conv"]))
    return _sorted(both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")).mapInArrow(_apply, REPAIRED)


def structure_repair(conversations: DataFrame) -> DataFrame:
    """Results of damaging all rows and repairing each conversation: see RESULT, one row per original conv_id.

    Null roles and texts are one space, and so is a null conv_id or turn inside the crc32; rows with a null conv_id are one
    conversation, null turns come first and count for no gap.  Rows with equal turns are taken by role and
    text.  A role that begins with none of s, u, a (or is empty) can only be reroled or deleted.  A conversation without rows after
    damage has zeros, an empty audit and the hash of nothing; an empty table has no rows; other columns are ignored.
    A conversation of any length is sorted by Spark and streamed through one task, as its hash is one sequence.
    """
    return repair_audits(damage(conversations))
