"""Repair of the structure of conversations: the cheapest edits that make roles follow ``(s?(ua)+)?``, found on a stream of sorted turns.

Turns are repartitioned by conversation and sorted there, first to mark a role and text seen before, then by turn; both sorts spill. A task
reads its turns once, in Arrow batches, and carries over from one to the next: for each state of the pattern the least cost so far, the
order of the best edits that lead there, a running digest of the repaired turns, and a back pointer a turn. Costs relative to the least one are
bounded, as a state that costs more than coming from another cannot be part of the best edits, so there are few different situations: a turn
looks its step up, and its back pointer is the number of that step, two bytes. Beyond ``KEPT`` of them they go to an unnamed file
of the task itself, which vanishes with it.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3, the only one for blank and repeated turns), Insert an empty turn (2);
a truncated turn that is not deleted adds 1. Among the cheapest the least string of initials is taken. Two best edits that lead to different
states differ before the end of either, so their order never changes and is all that ties need.

A turn's first fault counts: blank (nothing but white space), duplicate (role and text earlier in the conversation), truncated (the last
character other than white space is not one of ``.!?``). A null role or text is one space. Turns of a conversation without number come
first; turns of the same number go by role and text. Turns without a conversation are one of their own. Rows that repeat others are turns as
others. A conversation without turns (all dropped by ``damage``) has zeros, no edits and the digest of nothing. An empty table gives
no rows; other columns play no part. One conversation is one task's work, as its digest runs over its turns in order: its turns are sorted
on disk and read once, and what grows with it in memory is the string of its edits.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Back pointers of a conversation that stay in memory.
KEPT = 1 << 20
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after the system's turn, after a user's, after an assistant's. The turn that may follow each, and where it leads.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
DONE = (0, 3)
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
FAULTS = ("blank", "duplicate", "truncated")


def _inserts(state: int) -> list[tuple[str, int, list[str]]]:
    """Letters, end and turns of inserting nothing or more; no state is passed twice."""
    out, seen, letters, turns = [("", state, [])], {state}, "", []
    while NEXT[state][1] not in seen:
        role, state = NEXT[state]
        seen.add(state)
        letters, turns = letters + "I", [*turns, f"{role}:"]
        out.append((letters, state, turns))
    return out


def _lead(state: int, turns: list[str]) -> bytes:
    """What inserted turns add to the repaired text; the very first one has no line feed before it."""
    joined = "".join(f"\n{t}" for t in turns)
    return (joined[1:] if state == 0 and joined else joined).encode()


class Steps:
    """Situations and the steps between them, each worked out when first met.

    A situation is a tuple of ``(state, cost above the least)``, the states in the order of their best edits. A step has its number, the next
    situation, what the least cost grows by, and for each of the next states: its predecessor's place, the edits, the bytes of the
    inserted turns with what separates the turn itself, and the turn's new role (None: its own; "": it is deleted).
    """

    def __init__(self):
        self.known: dict[tuple, tuple] = {}
        self.backs: list[list[tuple[int, str]]] = []

    def get(self, situation: tuple, turn: tuple[str, str]) -> tuple:
        found = self.known.get((situation, turn))
        if found is None:
            found = self.known[situation, turn] = self._make(situation, *turn)
            self.backs.append([(r, letters) for r, letters, *_ in found[3]])
            if len(self.backs) > 1 << 16:
                raise AssertionError("more steps than a back pointer has room for")
        return found

    def _make(self, situation: tuple, initial: str, fault: str) -> tuple:
        best: dict[int, tuple] = {}
        for r, (state, cost) in enumerate(situation):
            for letters, at, turns in _inserts(state):
                spent = cost + 2 * len(letters)
                options = [("D", 3, at, "")]
                if fault not in ("blank", "duplicate"):
                    late = int(fault == "truncated")
                    if (initial, at) in KEEPS:
                        options.append(("K", late, KEEPS[initial, at], None))
                    role, to = NEXT[at]
                    options.append(("R", 2 + late, to, role))
                for letter, price, to, role in options:
                    lead = _lead(state, turns)
                    if role != "" and (state or turns):
                        lead += b"\n"
                    made = (spent + price, r, letters + letter, lead, role)
                    if to not in best or made[:3] < best[to][:3]:
                        best[to] = made
        cost = {q: b[0] for q, b in best.items()}
        limit = {}
        for q, c in cost.items():
            for letters, at, _ in _inserts(q):
                limit[at] = min(limit.get(at, c + 2 * len(letters)), c + 2 * len(letters))
        # what another state can do in place of 0 and 1: delete the system's turn, insert up to a whole pair
        for q, more in ((3, 3), (2, 5), (1, 4)):
            if q in cost:
                limit[0] = min(limit.get(0, cost[q] + more), cost[q] + more)
        for q, more in ((3, 0), (2, 2), (0, 0)):
            if q in cost:
                limit[1] = min(limit.get(1, cost[q] + more), cost[q] + more)
        stay = sorted((q for q in best if cost[q] <= limit.get(q, cost[q])), key=lambda q: best[q][1:3])
        least = min(cost[q] for q in stay)
        after = tuple((q, cost[q] - least) for q in stay)
        return len(self.backs), after, least, [(best[q][1], best[q][2], best[q][3], best[q][4]) for q in stay]

    @staticmethod
    def finish(situation: tuple) -> tuple[int, int, str, bytes]:
        """Cost added, the place of the best state, the edits at the end and the turns they add."""
        ends = [(cost + 2 * len(letters), r, letters, _lead(state, turns)) for r, (state, cost) in enumerate(situation)
                for letters, at, turns in _inserts(state) if at in DONE]
        return min(ends)


class Pointers:
    """Back pointers of one conversation, two bytes each, read from the last one on."""

    def __init__(self):
        self.held, self.file, self.written = array("H"), None, 0

    def add(self, step: int) -> None:
        self.held.append(step)
        if len(self.held) >= KEPT:
            self.file = self.file or tempfile.TemporaryFile()
            self.held.tofile(self.file)
            self.written += len(self.held)
            self.held = array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        at = self.written
        while at:
            n = min(at, KEPT)
            at -= n
            self.file.seek(2 * at)
            part = array("H")
            part.fromfile(self.file, n)
            yield from reversed(part)
        if self.file:
            self.file.close()


class Conversation:
    """What is carried over from turn to turn."""

    def __init__(self, steps: Steps):
        self.steps = steps
        self.situation: tuple = ((0, 0),)
        self.digests = [hashlib.sha256()]
        self.pointers = Pointers()
        self.cost = self.illegal = self.distinct = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.before = self.low = self.high = None

    def add(self, number: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if number is not None:
            self.distinct += number != self.high
            self.low, self.high = number if self.low is None else self.low, number
        if fault:
            self.faults[fault] += 1
        number, self.situation, more, ways = self.steps.get(self.situation, (initial if initial in ("s", "u", "a") else "", fault))
        self.cost += more
        self.pointers.add(number)
        old, self.digests = self.digests, []
        for r, _, lead, new in ways:
            digest = old[r]
            if new != "" or lead:
                digest = digest.copy()
                digest.update(lead if new == "" else lead + f"{role if new is None else new}:{text}".encode())
            self.digests.append(digest)

    def row(self) -> tuple:
        more, r, letters, lead = self.steps.finish(self.situation)
        digest = self.digests[r].copy()
        digest.update(lead)
        audit = bytearray(letters[::-1].encode())
        for step in self.pointers.backwards():
            r, letters = self.steps.backs[step][r]
            audit += letters[::-1].encode()
        audit.reverse()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.faults.values(), self.illegal, self.cost + more, audit.decode(), digest.hexdigest()


ROW = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, dropped`` with nulls as one space."""
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                                F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))


def damage(turns: DataFrame) -> DataFrame:
    """A fixed quarter of faults by a hash of conversation and turn: dropped, empty, without end marks, repeated, or the user's."""
    def written(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(written("conv"), F.lit(":"), written("turn")).cast("binary")), F.lit(20))
    out = turns.withColumn("kind", kind)
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = out.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "dropped": F.col("dropped") | (F.col("kind") == 0)})
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def streamed(turns: DataFrame) -> DataFrame:
    """Turns in the order of a task's stream, with their fault; one shuffle, which both sorts use."""
    dealt = turns.repartition("conv")
    tail = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    digest = F.when(~F.col("dropped"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)))
    earlier = Window.partitionBy("conv", "digest").orderBy("turn", "role", "text")
    marked = dealt.withColumns({"tail": tail, "digest": digest}).withColumn("nth", F.row_number().over(earlier))
    fault = (F.when(F.col("dropped"), "").when(F.col("tail") == "", "blank").when(F.col("nth") > 1, "duplicate")
             .when(~F.col("tail").isin(".", "!", "?"), "truncated").otherwise(""))
    return marked.withColumn("fault", fault).drop("tail", "digest", "nth").sortWithinPartitions("conv", "turn", "role", "text")


def repair(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation of ``turns_of`` (perhaps after ``damage``): its faults, the cheapest edits and a digest of the repaired turns."""
    kind = turns.schema["conv"].dataType.simpleString()
    rows = streamed(turns).select(F.col("conv").cast("string").alias("conv"), F.coalesce("turn", F.lit(0)).alias("turn"),
                                  F.col("turn").isNull().alias("unnumbered"), "role", "text", "dropped", "fault")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, now, name, done = Steps(), None, None, []
        for batch in batches:
            for conv, turn, unnumbered, role, text, dropped, fault in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if now is None or conv != name:
                    if now is not None:
                        done.append((name, *now.row()))
                    now, name = Conversation(steps), conv
                if not dropped:
                    now.add(None if unnumbered else turn, role, text, fault)
            if done:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if now is not None:
            yield pd.DataFrame([(name, *now.row())], columns=columns)

    columns = ["conv", *(part.split(" ")[0] for part in ROW.split(", "))]
    return rows.mapInPandas(run, f"conv string, {ROW}").withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv_col)


def repaired_turns(turns: DataFrame, repairs: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The turns after the edits of ``repair``: ``conv_id, place (from 0), turn (null if inserted), role, text, edit``.

    The edits of a conversation stand before its turns in the stream and are followed along it.
    """
    kind = turns.schema["conv"].dataType.simpleString()
    none = F.lit(None)
    heads = repairs.select(F.col(conv_col).alias("conv"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("head"))
    both = turns.where(~F.col("dropped")).select("conv", "turn", "role", "text", F.lit(False).alias("head")).unionByName(heads)
    rows = both.repartition("conv").sortWithinPartitions("conv", F.desc("head"), "turn", "role", "text")
    rows = rows.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "head")
    columns = ["conv", "place", "turn", "role", "text", "edit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, audit, at, state, place = None, "", 0, 0, 0
        for batch in batches:
            done = []

            def inserted() -> None:
                nonlocal at, state, place
                while audit[at: at + 1] == "I":
                    role, state = NEXT[state]
                    done.append((name, place, None, role, "", "I"))
                    at, place = at + 1, place + 1

            for conv, turn, role, text, head in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if head:
                    inserted()
                    name, audit, at, state, place = conv, text, 0, 0, 0
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = NEXT[state]
                else:
                    state = KEEPS[role[:1], state]
                done.append((name, place, turn, role, text, edit))
                place += 1
            yield pd.DataFrame(done, columns=columns)
        done = []
        while audit[at: at + 1] == "I":
            role, state = NEXT[state]
            done.append((name, place, None, role, "", "I"))
            at, place = at + 1, place + 1
        yield pd.DataFrame(done, columns=columns)

    out = rows.mapInPandas(run, "conv string, place long, turn string, role string, text string, edit string")
    return out.withColumns({"conv": F.col("conv").cast(kind), "turn": F.col("turn").cast("long")}).withColumnRenamed("conv", conv_col)
