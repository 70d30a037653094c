"""Repair of a conversation's structure: its turns are aligned to the alternating grammar ``(s?(ua)+)?``.

The grammar has one string of each feasible length for each beginning (``uaua..`` and ``suaua..``), and a shorter one
is a prefix of a longer one, so a Wagner-Fischer table for each beginning aligns the turns to every feasible length at
once. The cost of an alignment found first bounds the table: cells that can't be on a way as cheap are left out, which
is Ukkonen's band around the diagonal, with the band's width given by that incumbent. Where several lengths cost the
same, the audits found by tracing them back are compared.

Rows of a conversation come to one task in order and stream through it ``PIECE`` rows at a time; between pieces only
the cheapest audit and the hash state of the repaired text are kept for each state of the grammar, so a conversation of
any length takes the memory of a piece and of its own audit. One hash over the whole repaired text is a chain through
its rows, so one conversation is one task's work, but never one task's memory.

Defined cases: turns come in ascending order, nulls first, those of one turn by role and text (both with nulls as one
space, bytewise); null ids of conversations are one conversation. An empty role has no initial: it is only replaced or
deleted, and a pair with it is illegal. An empty table gives no rows. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.memory import tidy

#: Rows aligned in one table.
PIECE = 256
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after ``s``, after ``u``, after ``a``. Those after which it may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
FAR = 1 << 40
NAMES = {"u": "user", "a": "assistant"}
_SPACE = r"[\x20\x09-\x0D]"
REPORT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) as the damage of the contract leaves them; a dropped row stays as a mark without text.

    Damage goes by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.``, ``!``
    and ``?``, 3 repeats it, 4 makes it the user's. Nulls count as one space everywhere but in order and in gaps.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


class Path(NamedTuple):
    """A cheapest way through rows: ``audit`` has a letter for each edit."""

    cost: int
    audit: str


def _table(codes: str, first: str, bound: int, low: int) -> np.ndarray:
    """Wagner-Fischer costs F[i, j] of the first i rows against the first j letters of the alternating string.

    ``codes`` has a row's initial, upper case where its end is missing, ``-`` where it must go and ``.`` where its
    initial fits nothing (``,`` if its end is missing too). Only the band is worked out where a way may cost ``bound``
    or less, given what the rows to come cost at least and that lengths below ``low`` are not asked for; the rest is FAR.
    """
    n = len(codes)
    floor, left = _bounds(codes)
    width = n + bound // INSERT + 2
    j = np.arange(width)
    letters = np.array([ord("u"), ord("a")])[(j + (first == "a")) % 2]
    out = np.full((n + 1, width), FAR, np.int64)
    a, b = 0, width
    for i in range(n + 1):
        if i:
            b = min(width, b + 1 + max(0, bound - int(out[i - 1, a:b].min())) // INSERT)
            row = out[i - 1, a:b] + DELETE
            c = codes[i - 1]
            if c != "-":
                late = _late(c)
                change = np.where(letters[a : b - 1] == ord(c.lower()), late, REROLE + late)
                row[1:] = np.minimum(row[1:], out[i - 1, a : b - 1] + change)
            row = np.minimum.accumulate(row - INSERT * j[a:b]) + INSERT * j[a:b]
        else:
            row = INSERT * j
        fits = row + floor[i] + INSERT * np.maximum(low - j[a:b] - left[i], 0) <= bound
        out[i, a:b] = np.where(fits, row, FAR)
        inside = np.flatnonzero(fits)
        a, b = a + int(inside[0]), a + int(inside[-1]) + 1
    return out


def _back(codes: str, first: str, costs: np.ndarray, m: int) -> str:
    """The ASCII-least audit of cost F[n, m]: cells on cheapest ways are marked from the end, letters taken from the start."""
    n = len(codes)
    other = "a" if first == "u" else "u"
    moves: dict[tuple[int, int], list[tuple[str, tuple[int, int]]]] = {}
    seen, todo = {(n, m)}, [(n, m)]
    while todo:
        i, j = cell = todo.pop()
        here = int(costs[i, j])
        found = []
        if i and costs[i - 1, j] + DELETE == here:
            found.append(("D", (i - 1, j)))
        if j and costs[i, j - 1] + INSERT == here:
            found.append(("I", (i, j - 1)))
        if i and j and codes[i - 1] != "-":
            c = codes[i - 1]
            late = _late(c)
            kept = c.lower() == (first if j % 2 else other)
            if costs[i - 1, j - 1] + late + (0 if kept else REROLE) == here:
                found.append(("K" if kept else "R", (i - 1, j - 1)))
        for letter, before in found:
            moves.setdefault(before, []).append((letter, cell))
            if before not in seen:
                seen.add(before)
                todo.append(before)
    audit, cell = [], (0, 0)
    while cell != (n, m):
        letter, cell = min(moves[cell])
        audit.append(letter)
    return "".join(audit)


def _late(code: str) -> int:
    return TRUNCATED if code.isupper() or code == "," else 0


def _bounds(codes: str) -> tuple[np.ndarray, np.ndarray]:
    """For every i, what the rows from i on cost at least, and how many of them may stay."""
    least = [DELETE if c == "-" else _late(c) for c in codes]
    stay = [c != "-" for c in codes]
    return np.append(np.cumsum(least[::-1], dtype=np.int64)[::-1], 0), np.append(np.cumsum(stay[::-1], dtype=np.int64)[::-1], 0)


def _incumbent(codes: str, first: str, m: int) -> int:
    """Cost of one plain alignment to the first m letters: row by row, what is over goes, what is missing comes."""
    cost, j = 0, 0
    for c in codes:
        if c == "-" or j == m:
            cost += DELETE
            continue
        late = _late(c)
        cost += late + (0 if c.lower() == ("a" if (j % 2 == 0) != (first == "u") else "u") else REROLE)
        j += 1
    return cost + INSERT * (m - j)


def aligned(codes: str, first: str, least: int) -> Path:
    """The cheapest, then ASCII-least audit over the lengths ``least``, ``least + 2``, .. of the string that begins with ``first``."""
    stay = sum(c != "-" for c in codes)
    near = max(least, stay - (stay - least) % 2)
    bound = min(_incumbent(codes, first, m) for m in (near, near + 2))
    costs = _table(codes, first, bound, least)
    ends = costs[-1, least::2]
    best = int(ends.min())
    return Path(best, min(_back(codes, first, costs, least + 2 * int(m)) for m in np.flatnonzero(ends == best)))


#: For each state, where the strings of the grammar lead from it: state, first letter and least length of the string.
_STRINGS = {
    EMPTY: ((USER, "u", 1), (ASSISTANT, "u", 2)),
    SYSTEM: ((USER, "u", 1), (ASSISTANT, "u", 2)),
    USER: ((USER, "a", 0), (ASSISTANT, "a", 1)),
    ASSISTANT: ((USER, "u", 1), (ASSISTANT, "u", 0)),
}


@lru_cache(maxsize=1 << 14)
def ways(codes: str, state: int, last: bool) -> dict[int, Path]:
    """From ``state`` over a piece of rows to every state it can end in (``last``: in which the grammar may end)."""
    out = {to: aligned(codes, first, least) for to, first, least in _STRINGS[state] if not last or to in ENDS}
    n = len(codes)
    if state in (EMPTY, SYSTEM) and (state == EMPTY or not last):
        out[state] = Path(DELETE * n, "D" * n)
    if state == EMPTY:  # the string that begins with s: its first letter is a row that is kept
        for i, c in enumerate(codes):
            if c not in "sS":
                continue
            head = Path(DELETE * i + _late(c), "D" * i + "K")
            if not last:
                path = Path(head.cost + DELETE * (n - i - 1), head.audit + "D" * (n - i - 1))
                out[SYSTEM] = min(path, out.get(SYSTEM, path))
            if any(head.cost <= out[to].cost for to in (USER, ASSISTANT) if to in out):
                for to, path in ways(codes[i + 1 :], SYSTEM, last).items():
                    if to != SYSTEM:
                        out[to] = min(out[to], Path(head.cost + path.cost, head.audit + path.audit))
    return out


def rendered(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int]:
    """``role:text`` of the rows that an audit leaves, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            role, text = rows[at]
            turn = role[0]
        else:
            turn = "a" if state == USER else "u"
            role, text = NAMES[turn], rows[at][1] if letter == "R" else ""
        at += letter != "I"
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[turn]
        out.append(f"{role}:{text}")
    return out, state


class _Conversation:
    """What is known of the conversation that streams by."""

    def __init__(self, key: Any):
        self.key, self.codes, self.rows = key, [], []
        self.best: dict[int, tuple[Path, Any, bool]] = {EMPTY: (Path(0, ""), hashlib.sha256(), False)}
        self.low = self.high = self.turn = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        fits = initial in ("s", "u", "a")
        self.codes.append("-" if fault in (1, 2) else (initial.upper() if fits else ",") if fault == 3 else initial if fits else ".")
        self.rows.append((role, text))
        if len(self.codes) > PIECE:
            self.piece(PIECE, False)

    def piece(self, n: int, last: bool) -> None:
        codes, rows = "".join(self.codes[:n]), self.rows[:n]
        del self.codes[:n], self.rows[:n]
        best: dict[int, tuple[Path, int, str]] = {}
        for state, (path, _, _) in self.best.items():
            for to, way in ways(codes, state, last).items():
                new = (Path(path.cost + way.cost, path.audit + way.audit), state, way.audit)
                if to not in best or new[0] < best[to][0]:
                    best[to] = new
        held = self.best
        self.best = {}
        for to, (path, state, audit) in best.items():
            _, digest, begun = held[state]
            digest, (lines, _) = digest.copy(), rendered(rows, audit, state)
            if lines:
                digest.update((("\n" if begun else "") + "\n".join(lines)).encode())
            self.best[to] = (path, digest, begun or bool(lines))

    def row(self) -> tuple:
        self.piece(len(self.codes), True)
        path, digest, _ = min(self.best.values(), key=lambda b: b[0])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, path.cost, path.audit, digest.hexdigest())


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: 1 blank, 2 duplicate, 3 truncated, 0 none, -1 a mark of a dropped row.

    Rows are dealt by conversation first; that a role and text came before is a window inside this deal, so it costs a
    sort and no shuffle of its own. Rows that are equal in turn, role and text are equal, so any of them is the first.
    """
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(rf"[.!?]{_SPACE}*\z")
    fault = F.when(F.col("gone"), -1).when(blank, 1).when(F.row_number().over(same) > 1, 2).when(~whole, 3).otherwise(0)
    return dealt.withColumn("fault", fault)


def repair(rows: DataFrame) -> DataFrame:
    """The repair of every conversation of ``rows`` (conv_id, turn, role, text, gone): counts of faults, cost, audit and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], key), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            key = batch.schema.field(0).type
            for k, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.key != k:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(k)
                if fault >= 0:
                    now.add(turn, role, text, fault)
            if len(out) >= 1000:
                yield packed()
        if now is not None:
            out.append(now.row())
        if out:
            yield packed()

    schema = REPORT.format(rows.schema["conv_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    # Equal rows stay in the order of their faults: the first one, without the fault of being a copy, comes first.
    in_order = faults(rows).select("conv_id", "turn", "role", "text", "fault").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == 2
    )
    return in_order.mapInArrow(tidy(run), schema)


