"""Repair of conversations against all edits of each conversation, one turn after another."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from cohortry.llm import conversations
from cohortry.llm.catalog import CATALOG
from tests.conftest import SMALL

BLANK = re.compile("[\x20\x09-\x0D]*")
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def key(turn):
    return (turn[0] is not None, turn[0] or 0, turn[1], turn[2])


def damaged(rows):
    """{conversation: turns} of rows (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {conv: sorted(turns, key=key) for conv, turns in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = re.sub("[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if BLANK.fullmatch(text) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, marks):
    """(cost, edits, repaired turns), from the last turn back, over all edits."""
    n = len(turns)
    best = [{} for _ in range(n + 1)]

    def keep(at, state, options):
        old = best[at].get(state)
        best[at][state] = min([o for o in [old, *options] if o is not None])

    for at in range(n, -1, -1):
        for state in range(4):
            options = []
            if at == n:
                options = [(0, "", ())] if state in (0, 3) else []
            else:
                _, role, text = turns[at]
                after = best[at + 1]
                if after:
                    cost, edits, rest = after[state]
                    options.append((cost + 3, "D" + edits, rest))
                    if marks[at] not in ("blank", "duplicate"):
                        late = int(marks[at] == "truncated")
                        to = 1 if role[:1] == "s" and state == 0 else NEXT[state][1] if role[:1] == NEXT[state][0][0] else None
                        if to is not None:
                            cost, edits, rest = after[to]
                            options.append((cost + late, "K" + edits, (f"{role}:{text}", *rest)))
                        cost, edits, rest = after[NEXT[state][1]]
                        options.append((cost + 2 + late, "R" + edits, (f"{NEXT[state][0]}:{text}", *rest)))
            if options:
                keep(at, state, options)
        for _ in range(4):  # turns inserted before this one
            for state in range(4):
                role, to = NEXT[state]
                if to in best[at]:
                    cost, edits, rest = best[at][to]
                    keep(at, state, [(cost + 2, "I" + edits, (f"{role}:", *rest))])
    return best[0][0]


def wanted(turns):
    marks = faults(turns)
    cost, edits, repaired = cheapest(turns, marks)
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return (gaps, *(marks.count(f) for f in conversations.FAULTS), illegal, cost, edits, sha), repaired


def values(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256


def rows(seed, count):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " \n", "", "Well!  ", "so:\t", "Ha! ha", "é.", None, "x.y", "\x1c", "…"]
    out = []
    for conv in range(count):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "system", "tool", None, "", "umpire"]])
        number = 0
        for k in range(rng.randrange(1, 14)):
            role = roles[k % 2] if rng.random() < 0.7 else rng.choice(roles)
            out.append((conv - 5 if conv % 40 else None, None if rng.random() < 0.05 else number, role, rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(10 ** 6)}."))
            number += rng.choice([0, 1, 1, 1, 1, 3])
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark):
    made = rows(1, 500)
    schema = "conv_id long, turn long, role string, text string, conv string, fault string, kind string, digest string, copy string"
    return made, spark.createDataFrame([(*r, "c", "f", "k", "d", "x") for r in made], schema).repartition(6)


def test_all_edits(spark, table):
    made, df = table
    got = {r.conv_id: values(r) for r in conversations.repair(conversations.damage(conversations.turns_of(df))).collect()}
    turns = damaged(made)
    assert set(got) == set(turns)
    for conv, own in turns.items():
        assert got[conv] == wanted(own)[0], (conv, own)


def test_undamaged_turns(spark, table):
    made, df = table
    turns = conversations.turns_of(df)
    repairs = conversations.repair(turns).cache()
    by_conv = {}
    for conv, *turn in made:
        by_conv.setdefault(conv, []).append((turn[0], " " if turn[1] is None else turn[1], " " if turn[2] is None else turn[2]))
    texts = {conv: wanted(sorted(own, key=key)) for conv, own in by_conv.items()}
    assert {r.conv_id: values(r) for r in repairs.collect()} == {conv: w[0] for conv, w in texts.items()}
    out = {}
    for r in sorted(conversations.repaired_turns(turns, repairs).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert out == {conv: list(w[1]) for conv, w in texts.items() if w[1]}


def test_random_situations():
    """Every situation is one of few, whatever the turns."""
    rng, steps = random.Random(5), conversations.Steps()
    turns = [(i, f) for i in ("s", "u", "a", "") for f in ("", "truncated", "blank")]
    for _ in range(400):
        own, situation = [rng.choice(turns) for _ in range(60)], ((0, 0),)
        for turn in own:
            situation = steps.get(situation, turn)[1]
    assert len(steps.known) < 5000


def test_spilled_pointers(spark, monkeypatch):
    monkeypatch.setattr(conversations, "KEPT", 3)
    steps = conversations.Steps()
    rng = random.Random(8)
    for _ in range(200):
        own = [(k, rng.choice(["user", "assistant", "system"]), f"{rng.choice('abc')}{k}{rng.choice(['.', ''])}") for k in range(rng.randrange(30))]
        now = conversations.Conversation(steps)
        for (number, role, text), fault in zip(own, faults(own), strict=True):
            now.add(number, role, text, fault)
        assert now.row() == wanted(own)[0]


def test_a_conversation_over_many_batches(spark):
    made = [(1, k, "user" if k % 2 == 0 else "assistant", f"line {k}.") for k in range(30_000)]
    df = spark.createDataFrame(made, "conv_id int, turn long, role string, text string")
    (r,) = conversations.repair(conversations.turns_of(df)).collect()
    assert (r.conv_id, r.cost, r.audit) == (1, 0, "K" * 30_000)
    assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in made).encode()).hexdigest()


def test_one_shuffle(spark, table):
    plan = conversations.repair(conversations.damage(conversations.turns_of(table[1])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_whole_table(spark):
    made = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: values(r) for r in CATALOG["op12_conversation_repair"](spark, SMALL).collect()}
    assert got == {conv: wanted(own)[0] for conv, own in damaged(made).items()}


def test_no_rows(spark, table):
    turns = conversations.turns_of(table[1].limit(0))
    repairs = conversations.repair(conversations.damage(turns))
    assert repairs.count() == 0 and conversations.repaired_turns(turns, repairs).count() == 0
